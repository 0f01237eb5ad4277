"""Importance resampling of a corpus towards a target, over hashed n-grams of words.

Texts of a batch are joined with separator sentinels and cut by one regular expression into
words and gaps. Lengths give every word's place, a binary search in the texts' offsets gives
its text, and n-grams whose words lie in different texts are masked out before counting. An
n-gram's crc32 comes from its words' by linear shifts, so no n-gram is ever built as a string.

Both corpora are counted whole; a task sends one row per bucket. The table of gains has one
number per bucket and is the only thing that returns to the executors. The draw is by largest
perturbed score; ranks come from range partitions and their sizes, no task orders them all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import LOWER, batch_of, schema, slices, stored

#: Over lower-cased UTF-8: words, and the runs between them.
RUNS = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
SENTINEL = b"\0"
LOWER_BYTES = LOWER.tobytes()
#: Bytes of texts joined at a time, and bytes cut into words at a time.
JOINED, BLOCK = 1 << 22, 1 << 20

BUCKETS = schema("bucket int, n bigint")
WEIGHTS = schema("doc_id bigint, n_words bigint, n_features bigint, weight bigint")


# Checksums of joined words --------------------------------------------------------------

def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values on each byte."""
    return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What 0 to 63 further bytes do to a checksum, and what 64, 128, 256 ... bytes do."""
    one = _byte_table()
    by = [np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(64):
        by.append((by[-1] >> 8) ^ one[by[-1] & 255])
    far = [by.pop()]
    while len(far) < 32:
        far.append(_apply(far[-1], far[-1]))
    return np.stack(by), far


_NEAR, _FAR = _shift_tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def shifted(c: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The checksum's part in that of a string which goes on for ``length`` bytes."""
    near, n = _NEAR.reshape(-1), (length & 63) * 1024
    c = near[n + (c & 255)] ^ near[n + 256 + (c >> 8 & 255)] ^ near[n + 512 + (c >> 16 & 255)] ^ near[n + 768 + (c >> 24)]
    for k in range(int(length.max(initial=0)).bit_length() - 6):
        long = np.flatnonzero(length >> (k + 6) & 1)
        c[long] = _apply(_FAR[k], c[long])
    return c


# N-grams --------------------------------------------------------------------------------

def ngrams(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """By block of the joined texts: the text of each word, and (text, crc32) of the n-grams that end in it.

    The last two words of a block go with the next, so blocks change nothing.
    """
    texts = [t or b"" for t in texts]
    joined = SENTINEL.join(texts).translate(LOWER_BYTES)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    crc, length = np.zeros(2, np.uint32), np.zeros(2, np.int64)
    doc, start = np.full(2, -1), 0
    while start < len(joined):
        gap = GAP.search(joined, start + BLOCK)
        end = gap.start() if gap else len(joined)
        runs = RUNS.findall(joined, start, end)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        first = 1 if GAP.match(runs[0]) else 0
        at = start + (np.cumsum(sizes) - sizes)[first::2]
        crc = np.concatenate([crc[-2:], np.fromiter(map(zlib.crc32, runs[first::2]), np.uint32, len(at))])
        length = np.concatenate([length[-2:], sizes[first::2]])
        doc = np.concatenate([doc[-2:], np.searchsorted(offsets, at, side="right") - 1])
        start = end
        after = shifted(np.full(len(crc), _SPACE), length) ^ crc  # of a space and the word
        two = shifted(crc[:-1], length[1:] + 1) ^ after[1:]
        three = shifted(two[:-1], length[2:] + 1) ^ after[2:]
        pair, triple = doc[1:-1] == doc[2:], doc[:-2] == doc[2:]
        own = doc[2:]
        yield own, [(own, crc[2:]), (own[pair], two[1:][pair]), (own[triple], three[triple])]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for part in slices(batch, "text", JOINED):
        yield part, part.column("text").cast(pa.large_binary()).to_pylist()


def bucket_counter(buckets: int):
    def count(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _texts(batch):
                for _, grams in ngrams(texts):
                    for _, crc in grams:
                        counts += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield batch_of(BUCKETS, used.astype(np.int32), counts[used])
    return count


def bucket_counts(texts: DataFrame, buckets: int) -> list[int]:
    """N-grams of all texts by bucket; collects at most ``buckets`` rows."""
    counts = [0] * buckets
    for row in texts.select("text").mapInArrow(bucket_counter(buckets), BUCKETS).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(target: list[int], raw: list[int]) -> list[int]:
    """Per bucket the floor of 1000 log(target share / raw share), both smoothed by one."""
    all_raw, all_target = float(sum(raw) + len(raw)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for t, s in zip(target, raw)]


def weigher(table: np.ndarray):
    def weigh(batches):
        for batch in batches:
            for part, texts in _texts(batch):
                n = part.num_rows
                words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
                for own, grams in ngrams(texts):
                    words += np.bincount(own, minlength=n)
                    for doc, crc in grams:
                        features += np.bincount(doc, minlength=n)
                        # sums of whole numbers far below 2**53, so doubles hold them
                        weight += np.bincount(doc, table[crc % np.uint32(len(table))], n).astype(np.int64)
                yield batch_of(WEIGHTS, part.column("doc_id"), words, features, weight)
    return weigh


# Drawing --------------------------------------------------------------------------------

def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """``rank`` 1, 2, 3 ... of the highest scores, ties to smaller ids; null beyond ``percent`` of the rows.

    Rows are range-partitioned and sorted, so a row's rank is its place in its partition plus
    the sizes of those before it; the driver sees one number per partition.
    """
    order = [F.desc("score"), F.asc("doc_id")]
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_at", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    rank = offsets[part] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("rank", F.when(rank <= percent * total // 100, rank)).drop("_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20,
             buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    ``weight`` is the sum of the gains of the text's n-grams of one to three words, ``score``
    adds Gumbel noise drawn from the seed and the id, and of the texts with ``min_words`` words
    the ``percent`` highest scores get a rank.

    Null and empty texts have no features and weight 0; a null id is empty text in the noise
    and comes first among ties; repeated rows count each time and have neighbouring ranks in
    either order. Empty tables give no rows, and without target texts all shares are smoothed
    ones. Only doc_id and text of ``docs`` and text of ``target`` are read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = np.array(gains(bucket_counts(target, buckets), bucket_counts(texts, buckets)), np.float64)
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((drawn.cast("double") + 0.5) / 4294967296.0)))
    scored = stored(texts.mapInArrow(weigher(table), WEIGHTS).withColumn("score", F.col("weight") + noise), "importance-scores")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    short = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(F.col("n_words") >= min_words), percent).select(columns).unionByName(short.select(columns))
