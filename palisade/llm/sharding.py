"""Operator 9: shards that all match the mixture of sources, by proportional stratified interleaving.

Within each source, rows are ranked in a seeded shuffle (the md5 of seed and doc_id); row r of a source of n rows gets the
fraction (r + 1/2) / n. Sorted by fraction, every stretch of rows holds each source in proportion. The sorted rows are cut into
shards whose counts differ by one at most (the law `rows`).

Both rankings are global, and neither meets a source or the table in one task: rows are dealt by the leading digits of the shuffle
(then of the fraction) into cells of about CELL_ROWS rows, ranked within their cell, and offset by the counts of the cells before,
which form a small table. A source with a third of all rows is spread over as many cells as its size asks for.

A null text has no bytes (size 1). Null sources are one source. Rows that tie in everything are interchangeable, and lie in one cell,
so one row repeated many times over makes a large one. Rows of one doc_id stand in order of size and checksum. An empty table gives no rows. Extra columns are ignored; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CELL_ROWS = 20_000
#: Cells whose counts are summed up together.
BLOCK = 1024
SEED = "palisade-9"


def _counted(rows: DataFrame, group: list[str]) -> DataFrame:
    """Of each cell: the rows in the cells before it and in all, within the group. Sums run over a block of BLOCK cells, and over the blocks."""
    cells = rows.groupBy(*group, "cell").agg(F.count("*").alias("in_cell")).withColumn("block", F.expr(f"cell div {BLOCK}"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy(*group, "block").agg(F.sum("in_cell").alias("in_block"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    blocks = blocks.select(*group, "block", F.coalesce(F.sum("in_block").over(earlier(whole.orderBy("block"))), F.lit(0)).alias("base"), F.sum("in_block").over(whole).alias("n"))
    inside = F.coalesce(F.sum("in_cell").over(earlier(Window.partitionBy(*group, "block").orderBy("cell"))), F.lit(0))
    return cells.withColumn("inside", inside).join(blocks, [*group, "block"]).select(*group, "cell", (F.col("base") + F.col("inside")).alias("before"), "n")


def assign_shards(df: DataFrame, shards: int = 8, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, source, size, text_crc32, position, shard, slot) of every row; position is its place in the interleaved order."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"), F.col(f"`{source_col}`").isNull().alias("no_source"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = written(rows.withColumn("shuffle", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string")))), "shard-keys")
    cells = max(1, -(-rows.count() // cell_rows))
    share = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("cell", F.floor(share * cells / F.lit(1 << 32)).cast("long"))
    by = ["source", "no_source"]
    rank = F.row_number().over(Window.partitionBy(*by, "cell").orderBy("shuffle", "doc_id", "size", "text_crc32"))
    ranked = rows.withColumn("rank", rank).join(_counted(rows, by), [*by, "cell"]).withColumn("r", F.col("before") + F.col("rank") - 1)
    # (2 r + 1) / (2 n) compared exactly: as a fixed point of 60 bits, ties broken by source
    fraction = F.expr("cast(floor(cast((2 * r + 1) as decimal(38, 0)) * cast(1152921504606846976 as decimal(38, 0)) / (2 * n)) as bigint)")
    dealt = written(ranked.select("doc_id", *by, "size", "text_crc32", "shuffle", fraction.alias("fraction")).withColumn("cell", F.expr(f"cast(floor(fraction * {cells}D / 1152921504606846976D) as bigint)")), "shard-fractions")
    order = Window.partitionBy("cell").orderBy("fraction", "no_source", "source", "shuffle", "doc_id", "size", "text_crc32")
    placed = dealt.withColumn("rank", F.row_number().over(order)).join(_counted(dealt, []), "cell").withColumn("position", F.col("before") + F.col("rank") - 1)
    shard = F.expr(f"(position * {shards}) div n")
    first = F.expr(f"(shard * n + {shards} - 1) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "text_crc32", "position", "shard", (F.col("position") - first).alias("slot"))
