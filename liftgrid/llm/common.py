"""Helpers shared by the operators of this package: text bytes, polynomial hashes, tables.

Text reaches Python as Arrow batches. A batch is cut into slices of bounded size
(``slices``), so numpy temporaries stay small whatever a batch holds; a text is never cut.
"""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftgrid.session import scratch_root

U64 = np.uint64
#: Bytes that separate words: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Hashes are polynomials modulo this prime, at two bases: modulo a power of two, strings that
#: repeat a pattern by its doubling rule collide whatever the base.
_PRIME = (1 << 31) - 1
_BASES = (1_103_515_245, 1_847_860_793)
_WIDE = 0x9E3779B97F4A7C15
#: Positions hashed at once, so that temporaries stay in the processor's cache.
_BLOCK = 1 << 15
#: Powers of both bases, then of their inverses.
_residues = [np.ones(1, np.uint32)] * 4
_powers = [np.ones(1, U64), np.ones(1, U64)]


# Tables on shared storage ---------------------------------------------------------------

_written: dict[str, list[str]] = {}


def _delete_at_exit(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    for path in _written.pop(sc.applicationId, []):
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_delete_at_exit, spark)
    path = f"{scratch_root(spark)}/liftgrid-llm/{label}-{uuid.uuid4().hex}"
    _written[app].append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder; it survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps whose tables are written.

    Spark deletes them when the plans that made them are collected as garbage, which on a
    driver with little to do comes late; a job of many steps would keep them all.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(docs: DataFrame, text: str = "text") -> tuple[Column, Column]:
    """What identifies a row: its id (null as the least long) and a hash of its text."""
    return (
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("txt"),
    )


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


# Bytes ----------------------------------------------------------------------------------

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end, and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes of text each; one row at least."""
    if batch.num_rows == 0:
        return
    _, at = utf8(batch.column(column))
    group = at[:-1] // size
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U64(32))


def _folded(x: np.ndarray) -> np.ndarray:
    """A number of at most the prime + 7 that equals x modulo the prime, whose bits are all ones."""
    p, shift = U64(_PRIME), U64(31)
    x = (x & p) + (x >> shift)
    return (x & p) + (x >> shift)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(x)
    return np.where(x >= _PRIME, x - U64(_PRIME), x)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and their inverses modulo 2**64, at least ``n`` of each.

    Sums of them find candidates and look pieces up; they do not tell crafted strings apart.
    """
    if len(_powers[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for k, base in enumerate((_WIDE, pow(_WIDE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def residues(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses modulo the prime, at least ``n`` of each."""
    if len(_residues[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for k, base in enumerate((*_BASES, *(pow(b, -1, _PRIME) for b in _BASES))):
            table, step = np.ones(1, U64), base
            while len(table) < size:
                table, step = np.concatenate([table, _reduced(table * U64(step))]), step * step % _PRIME
            _residues[k] = table.astype(np.uint32)
    return _residues


class PrefixHash:
    """Polynomial hashes of any substring, 31 bits at each of two bases, from one pass over the bytes."""

    def __init__(self, flat: np.ndarray):
        n = len(flat)
        up, self.down = residues(n + 1)[:2], residues(n + 1)[2:]
        self.sums = np.zeros((2, n + 1), np.uint32)
        for a in range(0, n, _BLOCK):
            b = min(a + _BLOCK, n)
            value = flat[a:b].astype(U64) + U64(1)
            for k in (0, 1):
                terms = value * up[k][a:b]  # at most 39 bits, a block's sum 54
                terms[0] += self.sums[k, a]
                self.sums[k, a + 1:b + 1] = _folded(np.cumsum(terms, dtype=U64))

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), U64)
        for a in range(0, len(out), _BLOCK):
            low, high = start[a:a + _BLOCK], end[a:a + _BLOCK]
            one, two = (
                _reduced((self.sums[k][high] + U64(2 * _PRIME) - self.sums[k][low]) * self.down[k][low]) for k in (0, 1))
            out[a:a + _BLOCK] = one << U64(32) | two
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))


def words(flat: np.ndarray, at: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the row it is in; ``gaps`` are the bytes between words."""
    if len(flat) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    letter = ~gaps[flat]
    first = np.zeros(len(flat) + 1, bool)
    first[at[:-1]] = True
    starts = letter.copy()
    starts[1:] &= ~letter[:-1] | first[1:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | first[1:-1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(at, start, side="right") - 1


def word_hashes(flat: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and the row it is in."""
    flat = LOWER[flat] if lower else flat
    start, end, row = words(flat, at)
    return PrefixHash(flat).of(start, end), row


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges start .. start + length - 1, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


KINDS = {
    "bigint": (T.LongType(), pa.int64()), "int": (T.IntegerType(), pa.int32()),
    "double": (T.DoubleType(), pa.float64()), "boolean": (T.BooleanType(), pa.bool_()),
    "string": (T.StringType(), pa.string()), "binary": (T.BinaryType(), pa.binary()),
    "array<bigint>": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "array<int>": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "array<double>": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
}


def schema(text: str) -> T.StructType:
    """Of "a bigint, b string" a StructType; needs no session."""
    fields = [part.split() for part in text.split(", ")]
    return T.StructType([T.StructField(name, KINDS[kind][0]) for name, kind in fields])


def batch_of(spec: T.StructType, *columns) -> pa.RecordBatch:
    arrays = []
    for field, values in zip(spec.fields, columns, strict=True):
        kind = KINDS[field.dataType.simpleString()][1]
        if isinstance(values, np.ndarray) and values.dtype == U64:
            values = values.view(np.int64)
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, names=spec.names)


# Connected components -------------------------------------------------------------------

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is the least node.

    Alternating large-star and small-star steps; each step is one aggregation with map-side
    combination and one join, and its result is a written table. Rounds grow with the
    logarithm of the longest chain.
    """
    def directed(a: str, b: str) -> list[Column]:
        return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]

    e = stored(edges.where("a <> b").select(*directed("a", "b")).distinct(), "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select("v", "m").toDF("u", "v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(*directed("v", "m")).unionByName(least.toDF("u", "v"))
        e = stored(small.distinct(), "edges")
        # stars: every node below has one node above, which has none
        above = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if above.where("n > 1").isEmpty() and e.join(above.select(F.col("u").alias("v")), "v", "leftsemi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
