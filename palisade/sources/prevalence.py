"""Prevalence tables that other programs write as one file: a header, then an open-addressing table of keyed hashes with their counts."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema as S
from ..functions.hashes import crc32c, siphash

# The layout of the file, little-endian.
MAGIC, VERSION = 0x50524556, 3
HEADER = struct.Struct("<IIQIIIIQIIQQ16x")
ENTRY = np.dtype([("hash", "<u8"), ("fleet_count", "<u4"), ("edge_count", "<u2"), ("source_count", "<u2")])
ROWS = "hash bigint, fleet_count bigint, edge_count int, source_count int"


@dataclass(frozen=True)
class Header:
    total: int
    slots: int
    entries: int
    checksum: int
    epoch: int
    begin: int
    count_max: int
    reporting_edges: int
    key: tuple[int, int]


def header_of(data: bytes, size: int) -> Header:
    """The header of a file of so many bytes; refuses what no reader could use."""
    if len(data) < HEADER.size:
        raise S.EngineError(S.EFORMAT, "a prevalence file breaks off in its header")
    magic, version, total, slots, entries, checksum, epoch, begin, most, edges, *key = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise S.EngineError(S.EFORMAT, "no prevalence file")
    if version != VERSION:
        raise S.EngineError(S.EVERSION, f"prevalence file of version {version}")
    if slots == 0 or slots & (slots - 1) or begin < HEADER.size or begin % 8 or begin + slots * ENTRY.itemsize > size:
        raise S.EngineError(S.EFORMAT, f"a prevalence table of {slots} slots from byte {begin} in a file of {size}")
    return Header(total, slots, entries, checksum, epoch, begin, most, edges, tuple(key))


def read_prevalence(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """The header, and (hash, counts) of every entry; a checksum that is set must hold."""
    file = spark.read.format("binaryFile").load(path)
    first = file.select(F.substring("content", 1, HEADER.size).alias("h"), "length").first()
    header = header_of(bytes(first["h"]), first["length"])
    out = to_arrow_schema(StructType.fromDDL(ROWS))

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                table = data.as_buffer()[header.begin : header.begin + header.slots * ENTRY.itemsize]
                if header.checksum and crc32c(table.to_pybytes()) != header.checksum:
                    raise S.EngineError(S.ECHECKSUM, "the entries of a prevalence file")
                entries = np.frombuffer(table, ENTRY)
                entries = entries[entries["hash"] != 0]
                for at in range(0, len(entries), 1 << 16):
                    own = entries[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own[n]).astype("<u8").view(np.int64) if n == "hash" else own[n].astype(t.type.to_pandas_dtype())) for n, t in zip(ENTRY.names, out, strict=True)], schema=out)

    return header, file.select("content").mapInArrow(run, ROWS)


def keyed(value: Column, key: tuple[int, int]) -> Column:
    """The hash under which a table of this key has a value; never 0, which marks an empty slot."""

    @F.pandas_udf("bigint")
    def hashed(values: pd.Series) -> pd.Series:
        x = siphash([v.encode("utf-8", "surrogatepass") for v in values], key)
        return pd.Series(np.where(x == 0, np.uint64(1), x).view(np.int64))

    return hashed(value)


def prevalence_of_file(values: DataFrame, value_col: str, header: Header, table: DataFrame) -> DataFrame:
    """values with their counts: 0 where absent or without a value, null where the table is cold (counts nothing)."""
    counts = ("fleet_count", "edge_count", "source_count")
    own = table.dropDuplicates(["hash"]).withColumnRenamed("hash", "__hash")
    value = F.col(value_col)
    rows = values.withColumn("__key", F.when(value != "", keyed(F.coalesce(value, F.lit("")), header.key))).join(own, F.col("__key") == F.col("__hash"), "left").drop("__key", "__hash")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) if header.count_max else F.lit(None).cast(dict(table.dtypes)[c]) for c in counts})
