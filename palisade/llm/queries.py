"""The registered queries of the training-data operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, ids_io, langid, media, paragraphs, setsketch, sharding, token_counts

WORD_TOKENIZER, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
END_ID = 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.write_tiles(media.store_texts(_table(spark, sf_dir, "documents"))))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (langid.fold_of() == 2).alias("held_out"))
    model = langid.train(docs.filter(~F.col("held_out")))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (langid.fold_of() == 2).alias("held_out"), "lang_pred", "score", "languages")


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "removed_words", "repeated_words", (F.col("repeated_words") > 0).alias("has_repeats"), F.length("text").cast("long").alias("n_chars_after"), F.sha2("text", 256).alias("text_sha256"))


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = chat.format_conversations(talks.unionByName(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("turns"))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = ids_io.write_shards(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), END_ID)
    return ids_io.read_shards(manifest)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_RANKS), piece_pattern())


def op9_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=8)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "position")


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_with_edits(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_RANKS), piece_pattern())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_media, op2_language_mixture, op3_paragraph_dedup, op4_setsketch_dedup, op5_spaced_seed_decontamination, op6_chat_round_trip, op7_token_shards, op8_byte_bpe, op9_stratified_shards, op10_edit_aware_counts, pipeline)
    return {f.__name__: f for f in own}


_OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words
), parts AS (
  SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT rep, len(s) AS n, unnest(s) AS e FROM parts
), together AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS k FROM items a JOIN items b ON a.e = b.e AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4
), links AS (
  SELECT a, b FROM together WHERE 100 * k >= 80 * (n + m - k)
), either_way AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT rep AS a, rep AS b FROM parts UNION SELECT r.a, l.b FROM reach r JOIN either_way l ON r.b = l.a
), comp AS (
  SELECT a AS rep, min(b) AS c FROM reach GROUP BY a
)
SELECT x.doc_id, CAST(len(x.s) AS BIGINT) AS n_shingles, coalesce(comp.c, x.doc_id) AS component_id, coalesce(comp.c, x.doc_id) = x.doc_id AS kept
FROM sets x LEFT JOIN parts p ON p.s = x.s LEFT JOIN comp ON comp.rep = p.rep
"""

_ESC = r"replace(replace(replace(replace(replace({0}, '\', '\s'), '<', '\l'), '>', '\g'), '[', '\b'), ']', '\d')"


def _op6_sql() -> str:
    shown = "CASE role WHEN 'user' THEN '[INST] ' || {0} || ' [/INST]' WHEN 'assistant' THEN '[ANS] ' || {0} || ' </s>' ELSE '[ROLE ' || " + _ESC.format("role") + " || '] ' || {0} || ' [/ROLE]' END"
    return rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, {shown.format("text")} AS plain, {shown.format(_ESC.format("text"))} AS escaped FROM rows
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS t,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    list(plain ORDER BY turn NULLS FIRST, role, text) AS parts, string_agg(plain, '' ORDER BY turn NULLS FIRST, role, text) AS plain,
    string_agg(escaped, '' ORDER BY turn NULLS FIRST, role, text) AS escaped FROM turns GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(t) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(CASE WHEN regexp_extract_all(plain, '\[INST\] .*? \[/INST\]|\[ANS\] .*? </s>|\[ROLE [^\]]*\] .*? \[/ROLE\]', 0, 's') = parts
    THEN 3 + length(plain) ELSE 8 + length(escaped) END AS BIGINT) AS formatted_chars FROM whole
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_setsketch_dedup": _OP4_SQL, "op6_chat_round_trip": _op6_sql()}
