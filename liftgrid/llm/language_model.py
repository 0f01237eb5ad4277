"""Interpolated modified Kneser-Ney bigram model: counted in Spark, scored from mapped files.

Counting. Each task counts its texts' words, then their pairs, and sends sorted arrays of
keys and counts to shards by hash, so a key leaves a task once however often it occurs and no
key makes a shard hot. A shard merges its arrays and writes them as one sorted array file in
the shared folder:

* words: the hashes of a hash range, sorted, with counts; a word's id is its rank over all
  shards. Ids 0 and 1 are the beginning and the end of a text.
* pairs: (id, id) keys sorted, with counts in a byte and an extra list for larger ones.
* contexts: for every id, how many different words follow it once, twice, more often, and how
  many different words precede it.

Scoring. Workers map the files into memory and look the keys up by binary search; pages are
shared by the workers of a machine and none is copied to the driver, which holds only paths
and a few totals. A file in a store that cannot be mapped is fetched to the worker's disk.

Order 2 is what a disk of four times the (compressed) input holds: three-word keys alone
would take as much as pairs and words together.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import U64, batch_of, bucket_of, mix, schema, scratch_path, slices, stored, utf8, word_hashes

SLICE = 1 << 21
BEGIN, END = 0, 1
#: Different keys that a task gathers before it sends them on.
GATHERED = 1 << 21
PIECES = schema("shard int, keys binary, counts binary")
SHARDS = schema("shard int, path string, n bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, extra string")
SCORES = schema("doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


# Files ----------------------------------------------------------------------------------

def write_arrays(folder: str, *arrays: np.ndarray) -> list[str]:
    """One file per array under a new name; a task that is run again writes others."""
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    paths = []
    for array in arrays:
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(np.ascontiguousarray(array).data if array.size else b"")
        paths.append(f"{folder}/{name}")
    return paths


@lru_cache(4096)
def mapped(path: str, kind: str) -> np.ndarray:
    """The file as a read-only array in mapped memory."""
    store, local = pafs.FileSystem.from_uri(path)
    if isinstance(store, pafs.LocalFileSystem):
        file = open(local, "rb")
    else:
        file = tempfile.TemporaryFile()  # has no name, so it goes with the worker
        with store.open_input_stream(local) as source:
            while data := source.read(1 << 24):
                file.write(data)
        file.flush()
    with file:
        size = os.fstat(file.fileno()).st_size
        if not size:
            return np.zeros(0, kind)
        return np.frombuffer(mmap.mmap(file.fileno(), size, access=mmap.ACCESS_READ), kind)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Range of the key's leading bits."""
    return ((key >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


# Counting -------------------------------------------------------------------------------

def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class _Gather:
    """Keys and counts of a task, sent on in pieces of bounded size."""

    def __init__(self, shards: int, place):
        self.shards, self.place = shards, place
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys, counts) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > GATHERED:
            keys, counts = counted(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
            if self.size > GATHERED // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        keys, counts = counted(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [], [], 0
        shard = self.place(keys)
        order = np.argsort(shard, kind="stable")
        keys, counts, shard = keys[order], counts[order], shard[order]
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                yield batch_of(PIECES, [s], [keys[a:b].tobytes()], [counts[a:b].astype(np.uint32).tobytes()])


def _words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(shards, lambda keys: shard_of(keys, shards))
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                h, _ = word_hashes(*utf8(batch.column("text")))
                yield from gather.add(*counted(h, np.ones(len(h), np.int64)))
        yield from gather.flush()
    return run


def _pairs(words: Words, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(shards, lambda keys: shard_of(mix(keys), shards))
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                key, _, _ = words.sequence(batch.column("text"))
                yield from gather.add(*counted(key, np.ones(len(key), np.int64)))
        yield from gather.flush()
    return run


def _merged(batches: Iterator[pa.RecordBatch], width: int = 1):
    """(shard, keys, count rows) of the shards in a task, which come one after the other."""
    current, keys, counts = None, [], []

    def close():
        k, c = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return current, k[first], np.add.reduceat(c, first, axis=0)

    for batch in batches:
        for shard, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if shard != current and keys:
                yield close()
                keys, counts = [], []
            current = shard
            keys.append(np.frombuffer(k, U64))
            counts.append(np.frombuffer(c, np.uint32).reshape(-1, width).astype(np.int64))
    if keys:
        yield close()


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches):
            paths = write_arrays(folder, keys, counts[:, 0])
            yield batch_of(SHARDS, [shard], [paths[0]], [len(keys)], [int(counts.sum())], *([0] for _ in range(4)), [paths[1]])
    return run


def _write_pairs(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts in _merged(batches):
            counts = counts[:, 0]
            large = np.flatnonzero(counts > 254)
            paths = write_arrays(folder, keys, np.minimum(counts, 255).astype(np.uint8), keys[large], counts[large])
            yield batch_of(SHARDS, [shard], [paths[0]], [len(keys)], [int(counts.sum())],
                           *([x] for x in _of_counts(counts)), [",".join(paths[1:])])
    return run


def _contexts(pairs: Pairs, words: Words, shards: int):
    """Of a pair file: what follows and what precedes each id, sent to the id's shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                keys, counts = pairs.file(shard)
                left, right = keys >> U64(32), keys & U64(0xFFFFFFFF)
                ids = np.concatenate([left, right])
                what = np.zeros((len(ids), 4), np.int64)
                what[np.arange(len(left)), np.minimum(counts, 3) - 1] = 1
                what[len(left):, 3] = 1
                order = np.argsort(ids, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
                ids, what = ids[order][first], np.add.reduceat(what[order], first, axis=0)
                cuts = np.searchsorted(ids, words.offsets.astype(U64))
                for s in range(shards):
                    a, b = cuts[s], cuts[s + 1]
                    if a < b:
                        yield batch_of(PIECES, [s], [ids[a:b].tobytes()], [what[a:b].astype(np.uint32).tobytes()])
    return run


def _write_contexts(folder: str, words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, what in _merged(batches, 4):
            start, stop = words.offsets[shard], words.offsets[shard + 1]
            table = np.zeros((stop - start, 4), np.uint32)
            table[ids.astype(np.int64) - start] = what
            path = write_arrays(folder, table)[0]
            before = table[:, 3]
            yield batch_of(SHARDS, [shard], [path], [len(table)], [int(before.sum())], *([x] for x in _of_counts(before)),
                           [str(int((before > 0).sum()))])
    return run


# The model ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Words:
    """Word shards; the first two ids are the marks of a text's beginning and end."""

    paths: tuple
    offsets: np.ndarray  # first id of each shard, and the end
    texts: int

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of each hash, -1 and 0 for words that were not counted."""
        different, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(different), -1), np.zeros(len(different), np.int64)
        shards = len(self.paths)
        cuts = np.searchsorted(shard_of(different, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if self.paths[s] is None:
                continue
            own = different[cuts[s]:cuts[s + 1]]
            keys, amounts = mapped(self.paths[s][0], "u8"), mapped(self.paths[s][1], "i8")
            spot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[spot] == own)
            skip = 2 if s == 0 else 0
            ids[cuts[s] + hit] = self.offsets[s] + skip + spot[hit]
            counts[cuts[s] + hit] = amounts[spot[hit]]
        return ids[back], counts[back]

    def sequence(self, texts: pa.Array):
        """Pair keys of the texts, each with its end mark; counts of the tokens; rows.

        A pair with an unknown word has the key of all ones.
        """
        h, row = word_hashes(*utf8(texts))
        ids, counts = self.ids(h)
        n = len(texts)
        cuts = np.searchsorted(row, np.arange(n + 1))
        ends = cuts[1:] + np.arange(n)  # place of each text's end mark
        size = len(h) + n
        is_end = np.zeros(size, bool)
        is_end[ends] = True
        token, amount = np.full(size, END), np.full(size, self.texts)
        token[~is_end], amount[~is_end] = ids, counts
        before = np.empty(size, np.int64)
        before[1:] = token[:-1]
        before[cuts[:-1] + np.arange(n)] = BEGIN
        key = (before.astype(U64) << U64(32)) | token.astype(U64)
        key[(before < 0) | (token < 0)] = U64(0xFFFFFFFFFFFFFFFF)
        return key, amount, (np.repeat(np.arange(n), np.diff(cuts) + 1), before, token)


@dataclass(frozen=True)
class Pairs:
    paths: tuple

    def file(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        keys_, counts_, large, amounts = self.paths[shard]
        keys, counts = mapped(keys_, "u8"), mapped(counts_, "u1").astype(np.int64)
        counts[counts == 255] = mapped(amounts, "i8")
        return keys, counts

    def counts(self, key: np.ndarray) -> np.ndarray:
        different, back = np.unique(key, return_inverse=True)
        out = np.zeros(len(different), np.int64)
        shards = len(self.paths)
        where = shard_of(mix(different), shards)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if self.paths[s] is None:
                continue
            keys_, counts_, large_, amounts = self.paths[s]
            place = order[cuts[s]:cuts[s + 1]]
            keys, own = mapped(keys_, "u8"), different[place]
            spot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[spot] == own)
            found = mapped(counts_, "u1")[spot[hit]].astype(np.int64)
            many = found == 255
            if many.any():
                found[many] = mapped(amounts, "i8")[np.searchsorted(mapped(large_, "u8"), own[hit][many])]
            out[place[hit]] = found
        return out[back]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2, 3 and more, after Chen and Goodman; defaults where a count of counts is 0."""
    out = [0.0, 0.5, 1.0, 1.5]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        below = (n1, n2, n3, n4)
        for k in (1, 2, 3):
            if below[k - 1]:
                out[k] = min(max(k - (k + 1) * y * below[k] / below[k - 1], 0.0), float(k))
    return np.array(out)


@dataclass(frozen=True)
class Model:
    words: Words
    pairs: Pairs
    contexts: tuple
    tokens: int
    types: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    pair_types: int
    word_back_off: float

    def context(self, ids: np.ndarray) -> np.ndarray:
        """Followers (seen once, twice, more often) and different predecessors of each id."""
        out = np.zeros((len(ids), 4))
        different, back = np.unique(ids, return_inverse=True)
        own = np.zeros((len(different), 4))
        cuts = np.searchsorted(different, self.words.offsets)
        for s in np.flatnonzero(np.diff(cuts)):
            if self.contexts[s] is not None:
                table = mapped(self.contexts[s], "u4").reshape(-1, 4)
                own[cuts[s]:cuts[s + 1]] = table[different[cuts[s]:cuts[s + 1]] - self.words.offsets[s]]
        out[:] = own[back]
        out[ids < 0] = 0
        return out

    def score(self, texts: pa.Array):
        """Per text: tokens, known tokens, base score, log10 probability."""
        n = len(texts)
        key, amount, (row, before, token) = self.words.sequence(texts)
        base = np.log10((amount + 0.1) / (self.tokens + 0.1 * (self.types + 1)))
        # the lower order: in how many different contexts a token stands
        ahead = self.context(token)[:, 3]
        kinds = np.minimum(ahead, 3).astype(int)
        uniform = self.word_back_off / (self.types + 1)
        lower = np.maximum(ahead - self.word_discounts[kinds], 0) / max(self.pair_types, 1) + uniform
        count = self.pairs.counts(key)
        total = np.empty(len(token))
        first = before == BEGIN
        total[1:] = amount[:-1]
        total[first] = self.words.texts
        total[before < 0] = 0
        follow = self.context(before)[:, :3] @ self.pair_discounts[1:]
        higher = np.maximum(count - self.pair_discounts[np.minimum(count, 3)], 0)
        known = total > 0
        p = lower.copy()
        p[known] = (higher[known] + follow[known] * lower[known]) / total[known]
        sums = lambda x: np.bincount(row, x, minlength=n)
        return sums(np.ones(len(row))).astype(np.int64), sums(amount > 0).astype(np.int64), sums(base), sums(np.log10(p))


def fit(docs: DataFrame, folds: int = 10) -> Model:
    """The model of the texts whose id's crc32 modulo ``folds`` is not 0."""
    spark = docs.sparkSession
    # shards follow the cluster's own measure of how finely to cut this input
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = scratch_path(spark, "language-model")
    texts = docs.where(bucket_of(F.col("doc_id"), folds) != 0).select(F.coalesce("text", F.lit("")).alias("text"))

    def merge(pieces: DataFrame, write) -> dict[int, object]:
        rows = pieces.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(write, SHARDS)
        return {r["shard"]: r for r in stored(rows, "model-files").collect()}  # a row per shard

    held = merge(texts.select("text").mapInArrow(_words(shards), PIECES), _write_words(folder))
    n_texts = texts.count()
    sizes = [held[s]["n"] if s in held else 0 for s in range(shards)]
    sizes[0] += 2
    words = Words(tuple((held[s]["path"], held[s]["extra"]) if s in held else None for s in range(shards)),
                  np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), n_texts)
    if words.offsets[-1] >= 1 << 32:
        raise ValueError("more different words than 32-bit ids")
    found = merge(texts.mapInArrow(_pairs(words, shards), PIECES), _write_pairs(folder))
    pairs = Pairs(tuple((found[s]["path"], *found[s]["extra"].split(",")) if s in found else None for s in range(shards)))
    files = spark.createDataFrame([(s,) for s in found], "shard int").repartition(max(1, len(found)))
    sides = merge(files.mapInArrow(_contexts(pairs, words, shards), PIECES), _write_contexts(folder, words))
    of = lambda rows: [sum(r[f"n{k}"] for r in rows.values()) for k in (1, 2, 3, 4)]
    pair_types = sum(r["total"] for r in sides.values())
    ones, twos, *_ = of(sides)
    many = sum(int(r["extra"]) for r in sides.values()) - ones - twos
    lower = discounts(*of(sides))
    return Model(
        words, pairs, tuple(sides[s]["path"] if s in sides else None for s in range(shards)),
        sum(r["total"] for r in held.values()) + n_texts,
        sum(r["n"] for r in held.values()) + (n_texts > 0), discounts(*of(found)), lower, pair_types,
        float(lower[1:] @ [ones, twos, many]) / pair_types if pair_types else 1.0)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield batch_of(SCORES, batch.column("doc_id"), *model.score(batch.column("text")))
    return run


def score(docs: DataFrame, model: Model, folds: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability of the text and its end) and perplexity.

    Null and empty texts are the end mark alone; null ids keep their rows; repeated rows
    score alike; without training texts every token has the uniform probability.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(_score(model), SCORES)
    return scored.select(
        "doc_id", (bucket_of(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
