"""Benchmark decontamination by latent semantic retrieval and order checks.

1. Words (runs of letters and digits, lower-cased in A-Z) are hashed into ``FEATURES``
   columns. Document frequencies of the columns are counted over all passages of all texts.
2. A randomised SVD of the TF-IDF passages of all texts gives ``RANK`` latent directions, the
   index of the search. Texts are hashed once, into a table of two bytes a word; products
   A^T (A W) over it are summed by tasks.
3. Every text is searched whole: windows of 16, 32 and 64 words slide over it by a quarter of
   their width, each compared by cosine with the benchmark passages of its length.
4. A candidate is checked first by the number of the passage's rarer words in it, which a
   long enough common subsequence needs, then by the subsequence: it counts if the longest
   common subsequence of its words and the passage's words covers ``cover`` of the passage, and that of its answer (the last sentence, else the last
   quarter) ``answer`` of the answer. Substituted or inserted words are thus tolerated.

Verbatim pieces are found by equal hashes of their first words as well, whatever their
direction. An index with fewer than ``RANK`` usable directions compares every window.

Benchmark passages of more than 64 words are searched in pieces. Items are taken in blocks, so
the number of items bounds neither the driver nor a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import LOWER, PrefixHash, batch_of, mix, ragged, schema, slices, stored, utf8, words

FEATURES, RANK, EXTRA = 1 << 14, 32, 24
#: Leading directions left out: they tell languages and function words, not passages.
TOP = 8
#: Columns in a greater share of the passages weigh nothing: function words.
COMMON = 0.03
#: Rarer words that a passage needs to be searched by its direction.
FEW = 8
#: Windows are sums of blocks of so many words.
STEP = 4
WIDTHS = (16, 32, 64)
PASSAGE = 64
SLICE = 1 << 20
BLOCK = 2048
#: Words that a task of the fit takes at least, so that its sums are not more than it reads.
SHARE = 1 << 23
#: Numbers of a sum that travel in one row.
PART = 1 << 14
#: Ranges added up at once, so that their sums stay in the processor's cache.
RANGES = 256
CODED = schema("columns binary")
PARTS = schema("part int, value binary")
FOUND = schema("doc_id bigint, item_id bigint")
GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, end to end, and n + 1 offsets."""
    flat, at = utf8(texts)
    flat = LOWER[flat]
    start, end, row = words(flat, at, GAPS)
    return PrefixHash(flat).of(start, end), np.searchsorted(row, np.arange(len(texts) + 1))


def columns(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def passages(cuts: np.ndarray) -> np.ndarray:
    """Start of each passage of PASSAGE words, and the end."""
    count = -(-np.diff(cuts) // PASSAGE)
    row = np.repeat(np.arange(len(count)), count)
    return np.append(cuts[row] + PASSAGE * (np.arange(len(row)) - (np.cumsum(count) - count)[row]), cuts[-1])


def _sum_parts(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k, piece in enumerate(np.array_split(totals, -(-len(totals) // PART))):
        yield batch_of(PARTS, [k], [piece.astype(np.float64).tobytes()])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("part").to_pylist(), batch.column("value").to_pylist()):
            value = np.frombuffer(raw)
            totals[k] = totals[k] + value if k in totals else value.copy()
    if totals:
        yield batch_of(PARTS, list(totals), [v.tobytes() for v in totals.values()])


def total(rows: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the tasks' arrays: parts are summed apart, their size does not grow."""
    added = rows.repartition("part").mapInArrow(_add, PARTS).collect()
    out = np.concatenate([np.frombuffer(r["value"]) for r in sorted(added, key=lambda r: r["part"])]) if added else np.zeros(shape)
    return out.reshape(shape)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each text's words."""
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            token, cuts = tokens(batch.column("text"))
            ends, code = pa.py_buffer((2 * cuts).astype(np.int32)), pa.py_buffer(columns(token).astype(np.uint16))
            yield batch_of(CODED, pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, ends, code]))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns of the words, end to end, and the start of each passage and the end."""
    for whole in batches:
        for batch in slices(whole, "columns", SLICE):
            flat, at = utf8(batch.column("columns"))
            yield flat.view(np.uint16), passages(at // 2)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(2 * FEATURES + 1)
    for column, start in _coded(batches):
        key = np.repeat(np.arange(len(start) - 1), np.diff(start)) * FEATURES + column
        key = np.sort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        totals[:FEATURES] += np.bincount(key[new] % FEATURES, minlength=FEATURES)
        totals[FEATURES:-1] += np.bincount(column, minlength=FEATURES)
        totals[-1] += len(start) - 1
    yield from _sum_parts(totals)


def range_sums(table: np.ndarray, index: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the rows table[index] over the ranges between ``cuts``, none of which is empty."""
    pieces = passages(cuts)
    size = np.diff(pieces)
    out = np.empty((len(size), table.shape[1]))
    order = np.argsort(-size, kind="stable")
    for a in range(0, len(order), RANGES):  # the longest first: those that have a k-th row lead
        own = order[a:a + RANGES]
        start, leading = pieces[own], np.searchsorted(-size[own], -np.arange(size[own[0]]))
        sums = table.take(index[start], axis=0)
        for k, n in enumerate(leading[1:].tolist(), 1):
            sums[:n] += table.take(index[start[:n] + k], axis=0)
        out[own] = sums
    return out if len(pieces) == len(cuts) else np.add.reduceat(out, np.searchsorted(pieces, cuts[:-1]), axis=0)


def _changes(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _images(idf: np.ndarray, basis: np.ndarray, batches: Iterator[pa.RecordBatch]):
    """A basis by slices: columns that weigh something and the cuts of their passages, the length
    of each passage, and the products, divided by the lengths."""
    weighted = basis * idf[:, None]
    for column, start in _coded(batches):
        own = np.flatnonzero(idf[column])
        if len(own):
            cuts = _changes(np.searchsorted(start, own, side="right"))
            column = column[own]
            size = np.sqrt(np.add.reduceat(idf[column] ** 2, cuts[:-1]))[:, None]  # rows of A have unit length, but for repeats
            yield column, cuts, size, range_sums(weighted, column, cuts) / size


def _products(idf: np.ndarray, basis: np.ndarray):
    """A^T (A basis) over the passages of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(basis.shape)
        for column, cuts, size, image in _images(idf, basis, batches):
            order = np.argsort(column, kind="stable")
            passage = np.repeat(np.arange(len(size)), np.diff(cuts))[order]
            first = _changes(column[order])
            own = column[order[first[:-1]]]
            out[own] += range_sums(image / size, passage, first) * idf[own, None]
        yield from _sum_parts(out.ravel())
    return run


def _gram(idf: np.ndarray, basis: np.ndarray):
    """(A basis)^T (A basis) over the passages of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((basis.shape[1],) * 2)
        for *_, image in _images(idf, basis, batches):
            out += image.T @ image
        yield from _sum_parts(out.ravel())
    return run


@dataclass(frozen=True)
class Index:
    """Latent rows of the feature columns, weighted by inverse document frequency and scaled
    to unit variance in each direction; the last row, of no column, is zero."""

    rows: np.ndarray
    rare: np.ndarray  # columns that weigh something
    whole: bool = True  # all directions are usable

    def sums(self, column: np.ndarray) -> np.ndarray:
        """Running sums of the latent rows over blocks of STEP words."""
        blocks = -(-len(column) // STEP)
        padded = np.full(blocks * STEP, len(self.rows) - 1)
        padded[:len(column)] = column
        out = np.zeros((blocks + 1, self.rows.shape[1]))
        for k in range(0, blocks, 1024):
            own = padded[k * STEP:(k + 1024) * STEP].reshape(-1, STEP).T
            block = self.rows.take(own[0], axis=0)
            for word in own[1:]:
                block += self.rows.take(word, axis=0)
            out[k + 1:k + 1025] = block
            np.cumsum(out[k:k + 1025], axis=0, out=out[k:k + 1025])
        return out

    @staticmethod
    def latent(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unit latent vectors of the windows (begin, end), widened to whole blocks."""
        vectors = (sums[-(-end // STEP)] - sums[begin // STEP]).astype(np.float32)
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        return vectors / np.maximum(norm, 1e-6)[:, None]


def weights(counted: np.ndarray) -> np.ndarray:
    """Inverse document frequencies; ``counted`` has the columns' passages and occurrences and, last, all passages."""
    passages_ = counted[:FEATURES]
    return np.where(passages_ <= max(COMMON * counted[-1], 3), np.log((1 + counted[-1]) / (1 + passages_)) + 1e-3, 0)


def build_index(docs: DataFrame, seed: int = 7) -> Index:
    """Frequencies over all texts, and directions by a randomised SVD of all their passages."""
    coded = stored(docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_code, CODED), "columns")
    counted = total(coded.mapInArrow(_frequencies, PARTS), (2 * FEATURES + 1,))
    idf = weights(counted)
    coded = coded.coalesce(max(1, int(counted[FEATURES:-1].sum()) // SHARE))
    basis = np.random.default_rng(seed).standard_normal((FEATURES, RANK + EXTRA))
    for _ in range(2):  # one product, one power iteration
        basis, _ = np.linalg.qr(total(coded.mapInArrow(_products(idf, basis), PARTS), basis.shape) + 1e-9 * basis)
    gram = total(coded.mapInArrow(_gram(idf, basis), PARTS), (basis.shape[1],) * 2)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    usable = int((values > 1e-6 * max(values[-1], 1e-9)).sum())
    values, vectors = values[::-1][TOP:TOP + RANK], vectors[:, ::-1][:, TOP:TOP + RANK]
    latent = (basis @ vectors) / np.sqrt(np.maximum(values, 1e-9 * max(values[0], 1e-9)))
    rows = latent * idf[:, None]
    # the mean word is taken off, so windows do not agree by what all texts have
    rows -= counted[FEATURES:-1] @ rows / max(counted[FEATURES:-1].sum(), 1)
    return Index(np.vstack([rows, np.zeros(RANK)]).astype(np.float32), idf > 0, usable >= TOP + RANK)


# Items ----------------------------------------------------------------------------------

def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Items:
    """Benchmark pieces by window width: (id, words, words of the answer) of each, their latent
    vectors, the rarer words with the pieces that hold them, and how many of these a match needs."""

    by_width: dict

    @classmethod
    def of(cls, rows: list[tuple[int, str]], index: Index, cosine: float, cover: float) -> Items:
        pieces: dict[int, list] = {w: [] for w in WIDTHS}
        for item_id, text in rows:
            token, _ = tokens(pa.array([text], pa.string()))
            tail = text.rstrip().rstrip(".!?").replace("!", ".").replace("?", ".").rpartition(".")[2]
            answer = len(tokens(pa.array([tail], pa.string()))[0])
            if not 3 <= answer < len(token):
                answer = max(1, len(token) // 4)
            count = max(1, math.ceil(len(token) / PASSAGE))
            for k, piece in enumerate(np.array_split(token, count)):
                if len(piece):
                    width = next(w for w in WIDTHS if len(piece) <= w)
                    pieces[width].append((item_id, piece.tolist(), piece[-answer:].tolist() if k == count - 1 else []))
        out = {}
        for width, own in pieces.items():
            if own:
                vectors = np.concatenate([
                    index.latent(index.sums(columns(np.array(p, np.uint64))), np.zeros(1, np.int64), np.array([len(p)]))
                    for _, p, _ in own])
                rare = [[x for x in p if index.rare[columns(np.array([x], np.uint64))[0]]] for _, p, _ in own]
                need = np.array([math.ceil(cover * len(p)) - (len(p) - len(r)) for (_, p, _), r in zip(own, rare)])
                word = np.array([x for r in rare for x in set(r)], np.uint64)
                piece = np.array([k for k, r in enumerate(rare) for _ in set(r)], np.int64)
                order = np.argsort(word, kind="stable")
                # few rarer words make no direction: such a piece is compared with every window
                limit = np.array([cosine if len(r) >= FEW and index.whole else -2.0 for r in rare], np.float32)
                out[width] = (own, vectors.T.copy(), limit, word[order], piece[order], need)
        return cls(out)


def starts(token: np.ndarray) -> np.ndarray:
    """A hash of the FEW words from each place on."""
    m = max(0, len(token) - FEW + 1)
    h = np.zeros(m, np.uint64)
    for k in range(FEW):
        h = mix(h * np.uint64(0x9DDFEA08EB382D69) + token[k:k + m])
    return h


def matching(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which values are among the sorted keys, where their first key stands, and how many equal it."""
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    leads = np.zeros(1 << 16, bool)  # most values differ from all keys in their first bits
    leads[keys >> np.uint64(48)] = True
    found = np.flatnonzero(leads[values >> np.uint64(48)])
    low = np.searchsorted(keys, values[found])
    equal = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == values[found])
    found, low = found[equal], low[equal]
    return found, low, np.searchsorted(keys, values[found], side="right") - low


def _hits(token, word, piece, order) -> np.ndarray:
    """Sorted piece * n + place of each place where a piece's rarer word stands."""
    found, low, sizes = matching(word, token[order])
    return np.sort(piece[ragged(low, sizes)] * len(token) + np.repeat(order[found], sizes))


def _searcher(index: Index, items: Items, cover: float, answer: float):
    def matches(region: list, piece: list, tail: list) -> bool:
        if common_subsequence(piece, region) < math.ceil(cover * len(piece)):
            return False
        return not tail or common_subsequence(tail, region) >= math.ceil(answer * len(tail))

    long = [(item, np.array(p, np.uint64)) for own, *_ in items.by_width.values() for item, p, _ in own if len(p) >= FEW]
    heads = np.array([starts(p[:FEW])[0] for _, p in long], np.uint64)
    order = np.argsort(heads, kind="stable")
    heads = heads[order]

    def verbatim(token, cuts) -> set:
        """(row, item) of the texts that hold a piece word for word; shorter pieces meet every window."""
        found = set()
        for at, low, size in zip(*(x.tolist() for x in matching(heads, starts(token)))):
            doc = int(np.searchsorted(cuts, at, side="right")) - 1
            for k in order[low:low + size].tolist():
                item, piece = long[k]
                if (doc, item) not in found and at + len(piece) <= cuts[doc + 1] and (token[at:at + len(piece)] == piece).all():
                    found.add((doc, item))
        return found

    def search(texts: pa.Array) -> list[tuple[int, int]]:
        """(row, item) of the texts that hold an item."""
        token, cuts = tokens(texts)
        column = columns(token)
        # texts begin at whole blocks, so a text's windows do not depend on its neighbours
        places = np.concatenate([[0], np.cumsum(-(-np.diff(cuts) // STEP) * STEP)])
        padded = np.full(places[-1], len(index.rows) - 1)
        padded[ragged(places[:-1], np.diff(cuts))] = column
        sums, rare = index.sums(padded), np.flatnonzero(index.rare[column])
        pairs = verbatim(token, cuts)
        for width, (own, vectors, limit, word, piece_of, need) in items.by_width.items():
            step = width // 4
            hits = _hits(token, word, piece_of, rare)
            count = np.where(np.diff(cuts) > 0, 1 + -(-np.maximum(np.diff(cuts) - width, 0) // step), 0)
            row = np.repeat(np.arange(len(count)), count)
            begin = cuts[row] + step * (np.arange(len(row)) - (np.cumsum(count) - count)[row])
            for a in range(0, len(row), 1 << 13):
                b, r = begin[a:a + (1 << 13)], row[a:a + (1 << 13)]
                shift = places[r] - cuts[r]
                near = index.latent(sums, b + shift, np.minimum(b + width, cuts[r + 1]) + shift) @ vectors
                k, w = np.nonzero(np.ascontiguousarray((near >= limit).T))  # by piece, as the hits are
                lo, hi = np.maximum(cuts[r[w]], b[w] - step), np.minimum(cuts[r[w] + 1], b[w] + width + step)
                inside = np.searchsorted(hits, k * len(token) + hi) - np.searchsorted(hits, k * len(token) + lo)
                keep = np.flatnonzero(inside >= need[k])
                for doc, k_, x, y in zip(r[w[keep]].tolist(), k[keep].tolist(), lo[keep].tolist(), hi[keep].tolist()):
                    item, piece, tail = own[k_]
                    if (doc, item) not in pairs and matches(token[x:y].tolist(), piece, tail):
                        pairs.add((doc, item))
        return sorted(pairs, key=lambda p: (p[0], p[1] is None, p[1] or 0))  # an item's id may be null

    return search


def _search(*settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(*settings)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                pairs = search(batch.column("text"))
                ids = batch.column("doc_id").to_pylist()
                yield batch_of(FOUND, [ids[d] for d, _ in pairs], [i for _, i in pairs])
    return run


def _without(*settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(*settings)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, _ in search(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))
    return run


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The distinct items, BLOCK of them at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    block = []
    for r in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def without_leaks(docs: DataFrame, benchmark: DataFrame, index: Index | None = None, cosine: float = 0.3,
                  cover: float = 0.7, answer: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which ``find_leaks`` finds nothing."""
    index = index or build_index(docs)
    for block in item_blocks(benchmark):
        docs = docs.mapInArrow(_without(index, Items.of(block, index, cosine, cover), cover, answer), docs.schema)
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, index: Index | None = None, cosine: float = 0.3,
               cover: float = 0.7, answer: float = 0.5) -> DataFrame:
    """(doc_id, item_id) of texts of ``docs`` (doc_id, text) that hold a passage of ``benchmark``.

    ``benchmark`` has item_id and text; null and empty passages match nothing, and so do null
    and empty texts. Repeated rows give equal rows; a null id of either side stays null;
    empty tables give an empty table. Other columns are not read.
    """
    index = index or build_index(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for block in item_blocks(benchmark):
        hits = texts.mapInArrow(_search(index, Items.of(block, index, cosine, cover), cover, answer), FOUND)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else texts.sparkSession.createDataFrame([], FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, item_ids (sorted, distinct). Hits are few, texts stay in place."""
    hits = stored(find_leaks(docs, benchmark, **settings), "leaks")
    items = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(items, rows["doc_id"].eqNullSafe(items["doc_id"]), "left").select(
        rows["doc_id"], F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))
