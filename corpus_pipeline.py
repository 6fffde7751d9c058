"""The corpus pipeline: language identification, near-duplicate removal, passage deduplication, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame that run() writes
as Parquet into the shared folder and reads again as the next stage's docs. All but the last return the columns of documents.

In every stage a row is known by its doc_id and text together, so rows with a null doc_id, and rows that repeat one with another
text, are documents of their own; rows with equal doc_id and text are one document, of which the second stage keeps one row. Nulls
in other columns pass through, columns of any name too, and an empty table gives an empty one. What else each stage does with null
and empty texts and with ties its docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, decontam, langid, paragraphs, setsketch
from palisade.llm.common import written
from palisade.llm.queries import BYTE_RANKS, piece_pattern, tokenizer_path

#: Least proportion of the main language of a document that stays.
LEAST_SCORE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def with_own_ids(docs: DataFrame, own: str) -> tuple[DataFrame, bool]:
    """docs with a column own, and whether it differs in every row: doc_id, or, where ids are null or name several texts, a number for
    each id and text in the order of ids, nulls last."""
    if not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").head(1):
        return docs.withColumn(own, F.col("doc_id")), True
    texts = written(docs.select("doc_id", F.xxhash64("text").alias("hash")).distinct(), "ids")
    if not texts.groupBy("doc_id").count().filter("count > 1 or doc_id is null").head(1):
        return docs.withColumn(own, F.col("doc_id")), False
    ranked = texts.sort(F.col("doc_id").asc_nulls_last(), "hash").withColumn("own", F.monotonically_increasing_id())
    ids = written(ranked, "own-ids").select(F.col("doc_id").alias(f"{own}doc"), F.col("hash").alias(f"{own}hash"), F.col("own").alias(own))
    found = docs.join(ids, docs["doc_id"].eqNullSafe(F.col(f"{own}doc")) & (F.xxhash64(docs["text"]) == F.col(f"{own}hash"))).select(docs["*"], own)
    return written(found, "own-documents"), False


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language that has at least half of the text; lang becomes the prediction where it was null.

    Null and empty texts and texts without a letter go. Of languages with equal proportions the model's first counts. Learns from
    the labelled documents of docs; if none is labelled, all go. Rows with equal doc_id and text stay or go together.
    """
    model = langid.train(docs.filter(langid.fold_of() != 2))
    lang, score, _ = names = tuple(_free(docs, f"__{name}") for name in ("predicted", "score", "languages"))
    kept = langid.with_language(docs, model, names).filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group, over shingles of five words at a similarity of 0.8.

    Null ids come last; of texts with one doc_id the order is that of their hashes. Null and empty texts are in no group and stay. Of
    rows with equal doc_id and text one stays: the texts are equal, and so are the rows but for their other columns.
    """
    name = _free(docs, "__own")
    own, different = with_own_ids(docs, name)
    kept = setsketch.near_duplicates(own, shingle_words=5, percent=80, id_col=name).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    found = own.join(kept, name, "left_semi")
    return (found if different else found.dropDuplicates([name])).select(*_columns(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document of lower doc_id has, and counts n_chars again.

    Null and empty texts stay as they are, with n_chars null for a null text; a document that is cut whole stays with an empty text.
    Null ids come last, so theirs are cut; of texts with one doc_id the order is that of their hashes.
    """
    name = _free(docs, "__own")
    done = paragraphs.remove_repeats(with_own_ids(docs, name)[0], id_col=name, added=(_free(docs, "__removed"), _free(docs, "__repeated")))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, whatever their doc_id; null and empty texts are clean and stay."""
    flag = _free(docs, "__contaminated")
    return decontam.with_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), flag).filter(~F.col(flag)).select(*_columns(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes the ids again: (doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; null and empty texts have no ids."""
    return bpe.round_trip_digests(docs, tokenizer_path(BYTE_RANKS), piece_pattern())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenize),
]

#: Likelihoods, sketches and merges are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
