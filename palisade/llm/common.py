"""Shared plumbing of the training-data operators: shared folders, written tables, Arrow batches, hashes of words and shingles."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a batch that a Python worker handles at once, and bytes of text from which it takes fewer; longer Arrow batches are sliced.
ROWS_AT_ONCE, TEXT_AT_ONCE = 512, 1 << 22

#: For tables of written() in a local folder: no checksum file beside each file. For each file and folder there Hadoop starts a process
#: that sets its mode and that for a moment shares the memory of the executor's JVM; checksum files take half as many again.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; in local mode without that setting, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="palisade-")
    return _own_folder[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df as a table written to the shared folder and read again: lineage is cut, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.options(compression=compression, **PLAIN_FILES).parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.written_to = path
    return again


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold ROWS_AT_ONCE rows at most from now on. Spark's default of 10,000 texts a batch has no bound in
    bytes worth the name, outside the heap of the executor and once more in its worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def map_batches(df: DataFrame, columns: dict[str, str], make: Callable[[], Callable[[pa.RecordBatch], Iterable]], schema: str) -> DataFrame:
    """mapInArrow over the named columns (name: SQL type) in slices of ROWS_AT_ONCE.

    make() runs once in a task and gives the function from a slice to a dict of column values (or None). Other columns of df,
    whatever their names, never reach Python.
    """
    spark = df.sparkSession
    bound_batches(spark)
    out = pa_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                got = f(part)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip((got[n] for n in out.names), out, strict=True)], schema=out)
        pa.default_memory_pool().release_unused()  # the worker waits for its next task, perhaps for long

    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items())).mapInArrow(run, schema)


def add_columns(df: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], list]], added: str) -> DataFrame:
    """df with further columns (name: SQL type, as DDL) worked out from its texts, without a join; all other columns pass through,
    whatever their names and types. make() runs once in a task and gives the function from a slice of texts to the columns' values."""
    bound_batches(df.sparkSession)
    new = StructType.fromDDL(added)
    kinds = [t.type for t in pa_schema(df.sparkSession, added)]
    names, at = [*df.columns, *new.names], df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                made = [pa.array(x, t) for x, t in zip(f(part.column(at).cast(pa.string())), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)
        pa.default_memory_pool().release_unused()

    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # a name may hold dots
    return plain.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ROWS_AT_ONCE rows, and of TEXT_AT_ONCE bytes where a row has no more by itself."""
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64))
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_AT_ONCE, "right"))
        upto = max(at + 1, min(at + ROWS_AT_ONCE, most))
        yield batch.slice(at, upto - at)
        at = upto


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes, in order; with fewer words, of the whole sequence; without words, none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    x = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        x = mix64(x * _STEP + words[j : n - k + 1 + j])
    return x


def least_values(elements: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """For each factor and summand (32 bits), the least of the elements' hashes."""
    x = (elements >> np.uint64(32)).astype(np.uint32) ^ elements.astype(np.uint32)
    least = np.full(len(multiply), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * multiply + add).min(axis=0), out=least)
    return least


def least_values_of(elements: np.ndarray, ends: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """least_values of several sets, set k being elements[ends[k]:ends[k + 1]], none of them empty."""
    x = (elements >> np.uint64(32)).astype(np.uint32) ^ elements.astype(np.uint32)
    out, at = np.empty((len(ends) - 1, len(multiply)), np.uint32), 0
    while at < len(out):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + 512, "right")) - 1)
        if upto == at + 1:
            out[at] = least_values(elements[ends[at] : ends[upto]], multiply, add)
        else:
            own = x[ends[at] : ends[upto], None] * multiply + add
            out[at:upto] = np.minimum.reduceat(own, ends[at:upto] - ends[at], axis=0)
        at = upto
    return out


def low_bits(values: np.ndarray) -> np.ndarray:
    """The lowest bit of each value (of each row of values), packed to 64-bit integers: of least values of sets at similarity j, about (1 - j) / 2 differ."""
    rows = np.atleast_2d(values)
    out = np.zeros((len(rows), -(-rows.shape[1] // 64) * 8), np.uint8)
    packed = np.packbits((rows & 1).astype(np.uint8), axis=1)
    out[:, : packed.shape[1]] = packed
    return out.view(np.int64) if values.ndim > 1 else out[0].view(np.int64)


def most_differing(limit: float, bits: int, loss: float) -> int:
    """The least number of differing low bits, of so many, that a pair at the limit exceeds with probability loss at most."""
    p, most, above = (1 - limit) / 2, bits, 0.0
    while most > 0 and (above := above + math.comb(bits, most) * p**most * (1 - p) ** (bits - most)) <= loss:
        most -= 1
    return most


def differing_bits(a: str, b: str, bits: int) -> Column:
    """How many of so many low bits differ between two columns of low_bits."""
    return sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(-(-bits // 64)))


#: Bytes hashed at once, which bounds the memory for texts of any length; a longer word is hashed in one piece.
BYTES_AT_ONCE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A number for each byte, the same for a letter A-Z in either case.
_BYTE = mix64(np.arange(1001, 1257, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]
_POWER, _INVERSE = np.uint64(0x9E3779B97F4A7C1B), np.uint64(pow(0x9E3779B97F4A7C1B, -1, 1 << 64))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, x))))


_POWERS, _INVERSES = _powers(_POWER, BYTES_AT_ONCE), _powers(_INVERSE, BYTES_AT_ONCE)


@dataclass
class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts: their hashes without the case of A-Z, and where they lie.

    Row r has the words first[r] to first[r + 1]; word k the bytes begin[k] to end[k] of data, and row r the bytes offset[r] on.
    """

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    data: np.ndarray

    def of(self, row: int) -> slice:
        return slice(int(self.first[row]), int(self.first[row + 1]))


def words_of(texts: pa.Array) -> Words:
    """All words of a column of texts; a null text has none."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offset = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]
    offset = offset - offset[0]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[offset] = True
    begin = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
    end = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
    hashes = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        a = begin[at]
        upto = max(at + 1, int(np.searchsorted(end, a + BYTES_AT_ONCE, "right")))
        n = int(end[upto - 1] - a)
        power, inverse = (_POWERS, _INVERSES) if n <= BYTES_AT_ONCE else (_powers(_POWER, n), _powers(_INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[a : a + n]] * power[:n], out=sums[1:])
        b, e = begin[at:upto] - a, end[at:upto] - a
        hashes[at:upto] = mix64((sums[e] - sums[b]) * inverse[b] + (e - b).astype(np.uint64) * _STEP)
        at = upto
    return Words(hashes, begin, end, np.searchsorted(begin, offset), offset, data)


def all_shingles(words: Words, k: int) -> list[np.ndarray]:
    """shingle_hashes of each row."""
    x = shingle_hashes(words.hashes, k) if len(words.hashes) >= k else np.zeros(0, np.uint64)
    bounds = words.first.tolist()
    return [x[a : b - k + 1] if b - a >= k else shingle_hashes(words.hashes[a:b], k) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def lists(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    """A column of arrays; None is null."""
    sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = [r for r in rows if r is not None]
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind), mask=pa.array([r is None for r in rows], pa.bool_()))
