"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte is removed when it lies in a string of ``length`` bytes that also starts at another
place, in the same text or another one.

1. Every window of ``length`` bytes names an anchor: the ``GRAM``-byte substring in it with
   the least hash (the leftmost of equals). Equal windows have equal anchors, so windows are
   compared only where their anchor's hash occurs twice. Consecutive windows with one anchor
   form a segment. Segments with equal content repeat as a whole; this is an aggregation.
2. Of every other segment content at a repeated anchor one copy goes to the anchor's bucket.
   There the suffixes that start at the anchors are sorted, once to the right and once to
   the left, by a mergesort whose comparisons find the common extension of two suffixes by
   binary search over prefix polynomial hashes. Neighbours' common extensions are then
   verified byte by byte. Two windows at one distance from their anchors are equal if no
   smaller extension lies between them in either order.
3. Buckets of more than ``max_bucket`` different contents are counted window by window
   instead, which gives the same answer without gathering the bucket in one task.

Null texts are empty. Repeated rows are texts of their own, so they repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import (
    U64, PrefixHash, batch_of, fresh, ragged, row_key, schema, slices, stored, utf8,
)

GRAM = 64
SLICE = 1 << 19
SEGMENTS = schema("doc bigint, txt bigint, first bigint, last bigint, at bigint, anchor bigint, content bigint")
BUCKETS = schema("anchor bigint, doc bigint, txt bigint, first bigint, at bigint, whole boolean, bytes binary")
SPANS = schema("doc bigint, txt bigint, start bigint, stop bigint")
WINDOWS = schema("anchor bigint, h bigint, n bigint, doc bigint, txt bigint, start bigint")
RESULT = schema("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


# 1. Anchors and segments ----------------------------------------------------------------

def anchors(flat: np.ndarray, at: np.ndarray, length: int):
    """Segments of a slice: (row, first window, last window, anchor), positions in ``flat``."""
    gram = min(GRAM, length)
    none = np.zeros(0, np.int64)
    n = len(flat)
    if n < length:
        return none, none, none, none, None
    prefix = PrefixHash(flat)
    starts = np.arange(n - gram + 1)
    bits = U64(max(20, int(n).bit_length()))
    key = (prefix.of(starts, starts + gram) >> bits << bits) | starts.astype(U64)
    span = length - gram + 1
    least, width = key, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    windows = n - length + 1
    least = np.minimum(least[:windows], least[span - width:span - width + windows])
    place = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
    # windows that cross the end of a text are none
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:windows]
    whole = np.arange(windows) + length <= at[row + 1]
    change = np.ones(windows, bool)
    change[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(change & whole)
    inside = np.flatnonzero(whole)
    last = inside[np.searchsorted(inside, np.append(first[1:], windows), side="left") - 1]
    return row[first], first, last, place[first], prefix


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                flat, at = utf8(batch.column("text"))
                row, first, last, place, prefix = anchors(flat, at, length)
                if not len(row):
                    continue
                doc, txt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "txt"))
                base = at[row]
                yield batch_of(
                    SEGMENTS, doc[row], txt[row], first - base, last - base, place - base,
                    prefix.of(place, place + min(GRAM, length)), prefix.of(first, last + length),
                )
    return run


# 2. The suffix sort ---------------------------------------------------------------------

class Suffixes:
    """Suffixes at given places, read to the right or to the left, up to their own ends."""

    def __init__(self, flat, prefix, place, room, left: bool):
        self.flat, self.prefix, self.place, self.room, self.left = flat, prefix, place, room, left

    def extension(self, i, j):
        """Length of the common extension of suffixes i and j: a binary search over hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.room[i], self.room[j])
        p, q, raw = self.place[i], self.place[j], self.prefix.raw
        while (low < high).any():
            middle = (low + high + 1) >> 1
            if self.left:
                same = raw(p - middle, p) == raw(q - middle, q)
            else:
                same = raw(p, p + middle) == raw(q, q + middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def before(self, i, j):
        """Whether suffix i sorts before suffix j; equal suffixes do not."""
        common = self.extension(i, j)
        inside = common < np.minimum(self.room[i], self.room[j])
        step = -common - 1 if self.left else common
        edge = len(self.flat) - 1
        a = self.flat[np.clip(self.place[i] + step, 0, edge)]
        b = self.flat[np.clip(self.place[j] + step, 0, edge)]
        return np.where(inside, a < b, self.room[i] < self.room[j])

    def verified(self, i, j, common):
        """``common``, shortened where the bytes differ although the hashes agreed."""
        start = common if self.left else np.zeros_like(common)
        mine, other = (ragged(self.place[k] - start, common) for k in (i, j))
        if np.array_equal(self.flat[mine], self.flat[other]):
            return common
        common = common.copy()
        for k in range(len(common)):
            n, p, q = common[k], self.place[i[k]], self.place[j[k]]
            x, y = ((self.flat[p - n:p][::-1], self.flat[q - n:q][::-1]) if self.left else (self.flat[p:p + n], self.flat[q:q + n]))
            wrong = np.flatnonzero(x != y)
            common[k] = wrong[0] if len(wrong) else n
        return common


def merge_sort(suffixes: Suffixes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the suffixes inside each bucket (begin, size of each element's bucket).

    All buckets are merged at once: an element's place in the merged run is its place in its
    own run plus the number of elements of the other run before it, a binary search.
    """
    n = len(begin)
    order = np.arange(n)
    index = np.arange(n) - begin
    width = 1
    while n and width < size.max():
        where = np.flatnonzero(size > width)
        run = index[where] // width
        other = begin[where] + (run ^ 1) * width
        stop = np.minimum(other + width, begin[where] + size[where])
        live = other < stop
        where, run, other, stop = where[live], run[live], other[live], stop[live]
        mine, right = order[where], (run & 1).astype(bool)
        low, high = other.copy(), stop.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            a, b = mine[open_], order[middle]
            late = right[open_]
            # of equals the left run comes first
            up = suffixes.before(np.where(late, a, b), np.where(late, b, a))
            up = np.where(late, ~up, up)
            low[open_] = np.where(up, middle + 1, low[open_])
            high[open_] = np.where(up, high[open_], middle)
        target = begin[where] + (run >> 1) * 2 * width + (index[where] % width) + (low - other)
        order[target] = mine
        width *= 2
    return order


def repeated_windows(flat, starts, at, windows, bucket, length: int) -> np.ndarray:
    """(element, distance) matrix: the window that starts so far before the anchor repeats.

    Elements are sorted by bucket; ``starts`` are their first bytes in ``flat``, ``at`` their
    anchors, ``windows`` the number of windows of each.
    """
    n = len(starts)
    prefix = PrefixHash(flat)
    edge = np.ones(n, bool)
    edge[1:] = bucket[1:] != bucket[:-1]
    number = np.cumsum(edge) - 1
    sizes = np.bincount(number)
    begin, size = (np.cumsum(sizes) - sizes)[number], sizes[number]
    ends = starts + windows - 1 + length
    runs = []
    for left in (False, True):
        room = at - starts if left else ends - at
        suffixes = Suffixes(flat, prefix, at, room, left)
        order = merge_sort(suffixes, begin, size)
        common = np.zeros(n, np.int64)
        inner = np.flatnonzero(~edge)  # buckets keep their places
        if len(inner):
            i, j = order[inner - 1], order[inner]
            common[inner] = suffixes.verified(i, j, suffixes.extension(i, j))
        runs.append((order, common))
    far, near = at - starts, at - starts - windows + 1
    distances = int(far.max()) + 1 if n else 0
    hits = np.zeros((n, distances), bool)
    labels = np.zeros((2, n), np.int64)
    for o in range(distances):
        for k, need in enumerate((length - o, o)):
            order, common = runs[k]
            labels[k, order] = np.cumsum(edge | (common < need))
        live = np.flatnonzero((near <= o) & (o <= far))
        if len(live) < 2:
            continue
        key = labels[0, live] * (n + 1) + labels[1, live]
        rank = np.argsort(key, kind="stable")
        same = key[rank[1:]] == key[rank[:-1]]
        twice = np.zeros(len(live), bool)
        twice[rank[1:][same]] = True
        twice[rank[:-1][same]] = True
        hits[live[twice], o] = True
    return hits


def _spans(doc, txt, place, hits, length: int) -> pa.RecordBatch:
    """Runs of repeated windows as spans of bytes."""
    padded = np.zeros((hits.shape[0], hits.shape[1] + 2), np.int8)
    padded[:, 1:-1] = hits
    turn = np.diff(padded, axis=1)
    row, low = np.nonzero(turn == 1)
    _, high = np.nonzero(turn == -1)
    return batch_of(SPANS, doc[row], txt[row], place[row] - high + 1, place[row] - low + length)


def _sort_buckets(length: int, rows: int):
    def solve(table: pa.Table) -> pa.RecordBatch:
        get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        flat, cuts = utf8(table.column("bytes"))
        first, place = get("first"), get("at")
        starts = cuts[:-1]
        hits = repeated_windows(flat, starts, starts + place - first, np.diff(cuts) - length + 1, get("anchor"), length)
        hits[get("whole").astype(bool)] = False
        return _spans(get("doc"), get("txt"), place, hits, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                kept.append(batch.slice(a, rows))
                count += kept[-1].num_rows
                if count < rows:
                    continue
                table = pa.Table.from_batches(kept)
                anchor = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:  # the last bucket may go on in the next batch
                    yield solve(table.slice(0, cut))
                kept, count = table.slice(cut).to_batches(), len(anchor) - cut
        if count:
            yield solve(pa.Table.from_batches(kept))
    return run


# Bytes of chosen segments ---------------------------------------------------------------

def _cut_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 22):
                flat, at = utf8(batch.column("text"))
                parts = batch.column("parts")
                counts = np.diff(parts.offsets.to_numpy())
                values = parts.flatten()
                row = np.repeat(np.arange(batch.num_rows), counts)
                get = lambda c: values.field(c).to_numpy(zero_copy_only=False)
                first, last = get("first"), get("last")
                begin = at[row] + first
                sizes = last - first + length
                data = flat[ragged(begin, sizes)]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                cut = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                doc, txt = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "txt"))
                yield batch_of(BUCKETS, get("anchor"), doc, txt, first, get("at"), values.field("whole"), cut)
    return run


def _window_counts(length: int):
    """3. Windows of large buckets: one row for each different window of a slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "bytes", 1 << 18):
                flat, cuts = utf8(batch.column("bytes"))
                get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
                sizes = np.diff(cuts) - length + 1
                begin = ragged(cuts[:-1], sizes)
                h = PrefixHash(flat).of(begin, begin + length).view(np.int64)
                row = np.repeat(np.arange(batch.num_rows), sizes)
                start = begin - cuts[row] + get("first")[row]
                yield batch_of(WINDOWS, get("anchor")[row], h, np.where(get("whole")[row], 2, 1),
                               get("doc")[row], get("txt")[row], start)
    return run


# 4. The texts that are left -------------------------------------------------------------

def kept_bytes(text: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left of ``text`` without the spans; bytes removed; maximal runs removed."""
    removed, runs, end, kept = 0, 0, -1, []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if start > end:  # adjoining spans are one run
            kept.append(text[max(end, 0):start])
            runs += 1
            removed += stop - start
            end = stop
        elif stop > end:
            removed += stop - end
            end = stop
    return b"".join([*kept, text[max(end, 0):]]), removed, runs


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 23):
            flat, at = utf8(batch.column("text"))
            ids, spans = batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist()
            out = ([], [], [], [], [])
            for k, doc_id in enumerate(ids):
                text = flat[at[k]:at[k + 1]].tobytes()
                left, removed, runs = kept_bytes(text, spans[k])
                for values, value in zip(out, (len(text), removed, runs, hashlib.sha256(left).hexdigest(), left)):
                    values.append(value)
            yield batch_of(RESULT, ids, *out)


def _shorten(names: list[str], spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, own in enumerate(batch.column(spans).to_pylist()):
                if own:
                    texts[k] = kept_bytes(texts[k].encode(), own)[0].decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)
    return run


def without_repeats(docs: DataFrame, length: int = 400, max_bucket: int = 50_000) -> DataFrame:
    """The rows and columns of ``docs``, the repeated bytes taken out of text.

    A character that a cut splits goes whole. Where there is a column n_chars it is counted
    anew. Null texts stay null, texts without repeats stay as they are.
    """
    spans, doc, txt = (fresh(docs, c) for c in ("spans", "doc", "txt"))
    found = repeated_spans(docs, length, max_bucket).groupBy(F.col("doc").alias(doc), F.col("txt").alias(txt)).agg(
        F.collect_list(F.struct("start", "stop")).alias(spans))
    keys = row_key(docs)
    rows = docs.select("*", keys[0].alias(doc), keys[1].alias(txt)).join(found, [doc, txt], "left").select(*docs.columns, spans)
    out = rows.mapInArrow(_shorten(docs.columns, spans), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def repeated_spans(docs: DataFrame, length: int = 400, max_bucket: int = 50_000, batch_rows: int = 20_000) -> DataFrame:
    """Spans (doc, txt, start, stop) of repeated bytes; (doc, txt) is ``row_key``.

    Spans of one text may overlap. ``max_bucket`` decides only where a bucket is solved.
    """
    texts = docs.select(*row_key(docs), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    seen = stored(texts.mapInArrow(_segments(length), SEGMENTS), "segments")
    # a partial count leaves each task before the shuffle, so a hot anchor is a few rows
    twice = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    near = stored(seen.join(twice, "anchor", "leftsemi"), "repeated-anchors")
    contents = stored(
        near.groupBy("anchor", "content").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "txt", "first", "last", "at")).alias("one")),
        "contents")
    copies = contents.where("n > 1").select("anchor", "content")
    covered = near.join(copies, ["anchor", "content"], "leftsemi").select(
        "doc", "txt", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    mixed = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    chosen = contents.join(mixed, "anchor").select(
        "one.doc", "one.txt", F.struct(
            "anchor", "one.first", "one.last", "one.at", (F.col("n") > 1).alias("whole"),
            (F.col("contents") > max_bucket).alias("large")).alias("part"))
    parts = chosen.groupBy("doc", "txt").agg(F.collect_list("part").alias("parts"))
    # repeated rows have one row key and one set of parts
    wanted = texts.join(parts, ["doc", "txt"]).dropDuplicates(["doc", "txt"])

    def bytes_where(large: bool) -> DataFrame:
        own = wanted.withColumn("parts", F.filter("parts", lambda p: p["large"] == F.lit(large))).where(F.size("parts") > 0)
        return own.mapInArrow(_cut_segments(length), BUCKETS)

    sorted_ = bytes_where(False).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _sort_buckets(length, batch_rows), SPANS)
    spans = covered.unionByName(sorted_)
    if not mixed.where(F.col("contents") > max_bucket).isEmpty():
        windows = bytes_where(True).mapInArrow(_window_counts(length), WINDOWS)
        again = windows.groupBy("anchor", "h").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "h")
        spans = spans.unionByName(windows.join(again, ["anchor", "h"], "leftsemi").select(
            "doc", "txt", "start", (F.col("start") + length).alias("stop")))
    return spans


def remove_repeats(docs: DataFrame, length: int = 400, max_bucket: int = 50_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what is removed and the bytes that are left.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (binary;
    cutting may split a character). Null texts are empty; null ids keep their rows; an empty
    table gives an empty table; other columns of ``docs`` are not read.
    """
    spans = repeated_spans(docs, length, max_bucket).groupBy("doc", "txt").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"))
    doc, txt = row_key(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), doc, txt)
    return texts.join(spans, ["doc", "txt"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, RESULT)
