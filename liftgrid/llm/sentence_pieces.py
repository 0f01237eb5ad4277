"""SentencePiece encoding as a best path over a vocabulary's pieces, and decoding.

The vocabulary is read from a SentencePiece model file; a piece's score is the model's. The
encoding of a text is the tiling by pieces with the greatest sum of scores (of equals the
one whose last pieces are longer, inside a chunk); a character that no piece covers costs the least score
minus 10 and is written as byte pieces. This is the unigram lattice over the given scores.

* Ordinary texts: no piece holds a space after another character, so the lattice falls apart
  into units (spaces and what follows them). Each different unit is solved once, many units
  in lockstep. For vocabularies without that property the whole text is one unit.
* Giant texts: cut into chunks of ``CHUNK`` characters that are dealt to tasks. The state at a
  boundary is how many characters the piece across it still covers. A chunk's transfer matrix
  holds the best score from each entry to each exit state; matrices combine by the
  associative max-plus product. A scan over a text's matrices fixes the boundary states, and
  every chunk is then traced back on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import U64, batch_of, mix, powers, ragged, schema, slices, utf8

SPACE = 0x2581
UNKNOWN_PENALTY = 10
SLICE = 1 << 20
CHUNK = 4096
#: Characters from which a text is cut into chunks.
GIANT = 65_536
#: Units remembered by a task before it forgets them.
REMEMBERED = 300_000
LOW = -1e18
CHUNKS = schema("row bigint, chunk bigint, body string, ahead string")
MATRICES = schema("row bigint, chunk bigint, matrix array<double>")
STATES = schema("row bigint, chunk bigint, entry bigint, exit bigint")
TRACED = schema("row bigint, chunk bigint, score double, ids array<int>")


class Vocabulary:
    """Pieces, scores and byte pieces of a model; plain data, so it travels with a task."""

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], byte_ids: list[int], unknown: int, lead: bool):
        self.pieces, self.scores, self.normal = pieces, scores, normal
        self.byte_ids, self.unknown = byte_ids, unknown
        self.lead = lead  # whether the model puts a space before a text

    @classmethod
    def read(cls, model_file: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.vocab_size()
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        pieces = [model.id_to_piece(i) for i in range(n)]
        places = {p: i for i, p in enumerate(pieces)}
        byte_ids = [places.get(f"<0x{b:02X}>", model.unk_id()) for b in range(256)]
        return cls(pieces, [model.get_score(i) for i in range(n)], normal, byte_ids, model.unk_id(),
                   model.encode("a", out_type=str)[0].startswith("▁"))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Lattice:
    """The vocabulary as a sorted hash array, and the dynamic programmes over it."""

    def __init__(self, vocabulary: Vocabulary):
        ids = [i for i, ok in enumerate(vocabulary.normal) if ok and vocabulary.pieces[i]]
        points = [code_points(vocabulary.pieces[i]) for i in ids]
        sizes = np.array([len(p) for p in points])
        at = np.cumsum(sizes) - sizes
        sums = self.prefix(np.concatenate(points))
        keys = self.hashes(sums, at, at + sizes)
        rank = np.argsort(keys)
        self.keys, self.ids = keys[rank], np.array(ids)[rank]
        # most strings are no piece; their leading bits tell without a search
        self.seen = np.zeros(1 << 20, bool)
        self.seen[keys >> U64(44)] = True
        score = np.array([vocabulary.scores[i] for i in ids], np.float64)
        self.scores = score[rank]
        self.unknown_score = score.min() - UNKNOWN_PENALTY
        self.longest = int(sizes.max())
        # does a space only begin a piece, or fill it?
        self.splits = all((p[1:] != SPACE).all() or (p == SPACE).all() for p in points)
        self.lead = vocabulary.lead
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)
        # bytes of every piece, for decoding
        data = [b"" if not ok else vocabulary.pieces[i].replace("▁", " ").encode() for i, ok in enumerate(vocabulary.normal)]
        for b, i in enumerate(vocabulary.byte_ids):
            if i != vocabulary.unknown:
                data[i] = bytes([b])
        data[vocabulary.unknown] = " ⁇ ".encode()
        self.sizes = np.array([len(d) for d in data])
        self.at = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(data), np.uint8)

    @staticmethod
    def prefix(points: np.ndarray) -> np.ndarray:
        up, _ = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, U64)
        np.cumsum((mix(points.astype(U64) + U64(1)) | U64(1)) * up[: len(points)], dtype=U64, out=sums[1:])
        return sums

    @staticmethod
    def hashes(sums, start, end):
        return (sums[end] - sums[start]) * powers(len(sums))[1][start]

    def edges(self, sums, start, size: int, limit) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece of ``size`` characters at each start; LOW and -1 for none."""
        score, ids = np.full(len(start), LOW), np.full(len(start), -1, np.int32)
        inside = np.flatnonzero(start + size <= limit)
        if len(inside):
            key = self.hashes(sums, start[inside], start[inside] + size)
            maybe = np.flatnonzero(self.seen[key >> U64(44)])
            key, maybe = key[maybe], inside[maybe]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[spot] == key
            score[maybe[hit]], ids[maybe[hit]] = self.scores[spot[hit]], self.ids[spot[hit]]
        if size == 1:
            none = inside[ids[inside] < 0]
            score[none] = self.unknown_score  # id -1: its bytes
        return score, ids

    # Ordinary texts ----------------------------------------------------------------------

    def tile(self, points, start, end):
        """Best tiling of each unit: (unit, first, last, id) of its pieces in order, and scores."""
        sums = self.prefix(points)
        out, totals = [], np.zeros(len(start))
        length = end - start
        for group in np.unique(np.ceil(np.log2(np.maximum(length, 4))).astype(int)):
            units = np.flatnonzero(np.ceil(np.log2(np.maximum(length, 4))).astype(int) == group)
            width = int(length[units].max())
            step = max(1, (1 << 20) // (width * min(width, self.longest)))
            for a in range(0, len(units), step):
                out.append(self._tile(sums, units[a:a + step], start, end, totals))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none, none, totals
        unit, first, last, ids = (np.concatenate(x) for x in zip(*out))
        rank = np.lexsort((first, unit))
        return unit[rank], first[rank], last[rank], ids[rank], totals

    def _tile(self, sums, units, start, end, totals):
        begin, stop = start[units], end[units]
        n, width = len(units), int((stop - begin).max())
        most = min(self.longest, width)
        best = np.full((width + 1, n), LOW)
        best[0] = 0
        back, piece = np.zeros((width + 1, n), np.int16 if most < 32_000 else np.int64), np.zeros((width + 1, n), np.int32)
        starts = (np.arange(width)[:, None] + begin).ravel()
        limits = np.broadcast_to(stop, (width, n)).ravel()
        found = [tuple(x.reshape(width, n) for x in self.edges(sums, starts, size, limits)) for size in range(1, most + 1)]
        for target in range(1, width + 1):
            for size in range(min(most, target), 0, -1):  # of equal sums the longest piece stays
                score, ids = (x[target - size] for x in found[size - 1])
                sum_ = best[target - size] + score
                better = sum_ > best[target]
                best[target][better] = sum_[better]
                back[target][better] = size
                piece[target][better] = ids[better]
        at = stop - begin
        totals[units] = best[at, np.arange(n)]
        live = np.flatnonzero(at > 0)
        parts = []
        while len(live):
            size = back[at[live], live].astype(np.int64)
            parts.append((units[live], begin[live] + at[live] - size, begin[live] + at[live], piece[at[live], live]))
            at[live] -= size
            live = live[at[live] > 0]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (units[:0], units[:0], units[:0], piece[0][:0])

    def with_bytes(self, points, first, last, ids):
        """Ids with unknown characters as their bytes; and how many each piece became."""
        count = np.ones(len(ids), np.int64)
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids.astype(np.int32), count
        data = [self.byte_ids[list(chr(points[p]).encode("utf-8", "surrogatepass"))] for p in first[lost]]
        count[lost] = [len(d) for d in data]
        place = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        known = ids >= 0
        out[place[known]] = ids[known]
        out[ragged(place[lost], count[lost])] = np.concatenate(data)
        return out, count

    # Giant texts -------------------------------------------------------------------------

    def tables(self, points: list[np.ndarray], bodies: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, place, size - 1) scores and ids of the pieces that start inside the bodies."""
        wide, n = max(bodies), len(points)
        sizes = np.array([len(p) for p in points])
        at = np.cumsum(sizes) - sizes
        flat = np.concatenate(points)
        sums = self.prefix(flat)
        start = np.concatenate([a + np.arange(b) for a, b in zip(at, bodies)])
        chunk = np.repeat(np.arange(n), bodies)
        limit = np.repeat(at + sizes, bodies)
        if self.splits:  # no piece crosses a space that follows another character
            turn = np.flatnonzero((flat[1:] == SPACE) & (flat[:-1] != SPACE)) + 1
            limit = np.minimum(limit, np.append(turn, len(flat))[np.searchsorted(turn, start, side="right")])
        scores = np.full((n, wide, self.longest), LOW)
        ids = np.full((n, wide, self.longest), -1, np.int32)
        for size in range(1, self.longest + 1):
            scores[chunk, start - at[chunk], size - 1], ids[chunk, start - at[chunk], size - 1] = self.edges(sums, start, size, limit)
        for k, body in enumerate(bodies):
            scores[k, body:] = LOW
        return scores, ids

    def transfer(self, points: list[np.ndarray], bodies: list[int]) -> list[np.ndarray]:
        """Best score from each entry state to each exit state of each chunk."""
        states, wide = self.longest, max(bodies)
        scores, _ = self.tables(points, bodies)
        best = np.full((len(points), states, wide + states), LOW)
        best[:, np.arange(states), np.arange(states)] = 0
        for at in range(wide):
            ahead = best[:, :, at + 1:at + 1 + states]
            np.maximum(ahead, best[:, :, at, None] + scores[:, None, at], out=ahead)
        return [np.maximum(best[k, :, b:b + states], LOW) for k, b in enumerate(bodies)]

    def trace(self, points: list[np.ndarray], bodies: list[int], entry: list[int], exit_: list[int]):
        """Per chunk (first, last, id) of the pieces that start in it, and their score."""
        states, wide, n = self.longest, max(bodies), len(points)
        scores, ids = self.tables(points, bodies)
        best = np.full((n, wide + states), LOW)
        back = np.zeros((n, wide + states), np.int16)
        best[np.arange(n), entry] = 0
        sizes = np.arange(1, states + 1, dtype=np.int16)
        for at in range(wide):
            ahead, came = best[:, at + 1:at + 1 + states], back[:, at + 1:at + 1 + states]
            sums = best[:, at, None] + scores[:, at]
            better = sums > ahead  # of equal sums the longest piece stays
            np.copyto(ahead, sums, where=better)
            np.copyto(came, sizes, where=better)
        out = []
        for k, body in enumerate(bodies):
            at, cut, steps = body + exit_[k], [], back[k].tolist()
            while at > entry[k]:
                cut.append((at - steps[at], at))
                at -= steps[at]
            first, last = np.array(cut[::-1], np.int64).reshape(-1, 2).T
            out.append((first, last, ids[k, first, last - first - 1], float(best[k, body + exit_[k]])))
        return out

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the id lists that ``cuts`` bounds, end to end, and their offsets."""
        sizes = self.sizes[ids]
        data = self.data[ragged(self.at[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return data, ends[cuts]


@lru_cache(2)
def _lattice(key) -> Lattice:
    return Lattice(key.vocabulary)


class _Key:
    """Lets a worker keep the lattice of a vocabulary it has met."""

    def __init__(self, vocabulary):
        self.vocabulary = vocabulary
        self.mark = hash((tuple(vocabulary.pieces), tuple(vocabulary.scores)))

    def __hash__(self):
        return self.mark

    def __eq__(self, other):
        return self.mark == other.mark


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product of transfer matrices."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), LOW)


def prefix_products(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by doubling strides."""
    out, stride = list(matrices), 1
    while stride < len(out):
        out = [max_plus(out[k - stride], out[k]) if k >= stride else out[k] for k in range(len(out))]
        stride *= 2
    return out


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary of the best path from the text's start to its end."""
    reached = [m[0] for m in prefix_products(matrices)]  # from entry state 0
    state, states = 0, [0]
    for k in range(len(matrices) - 1, 0, -1):
        total = reached[k - 1] + matrices[k][:, state]
        state = int(np.flatnonzero(total == total.max())[-1])  # of equals the longer piece
        states.append(state)
    return [0, *states[::-1]]


# Spark ----------------------------------------------------------------------------------

class _Encoder:
    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self._forget()

    def _forget(self):
        self.known, self.place = np.zeros(0, U64), np.zeros(0, np.int64)
        self.first, self.count, self.score = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.ids = np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end, n + 1 offsets, and scores of the texts."""
        lattice = self.lattice
        if lattice.lead:
            texts = [" " + t if t else t for t in texts]
        sizes = np.array([len(t) for t in texts], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        points = code_points("".join(texts)).copy()
        points[points == 0x20] = SPACE
        begin = np.zeros(len(points), bool)
        begin[at[:-1][sizes > 0]] = True
        if lattice.splits and len(points):
            begin[1:] |= (points[1:] == SPACE) & (points[:-1] != SPACE)
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(points))
        if not len(start):
            return self.ids[:0], np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts))
        sums = lattice.prefix(points)
        h = lattice.hashes(sums, start, end)
        different, one, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        spot = np.minimum(np.searchsorted(self.known, different), max(len(self.known) - 1, 0))
        old = self.known[spot] == different if len(self.known) else np.zeros(len(different), bool)
        new = np.flatnonzero(~old)
        if len(new):
            unit, first, last, ids, score = lattice.tile(points, start[one[new]], end[one[new]])
            ids, count = lattice.with_bytes(points, first, last, ids)
            per = np.bincount(unit, count, minlength=len(new)).astype(np.int64)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(per) - per])
            self.count, self.score = np.concatenate([self.count, per]), np.concatenate([self.score, score])
            self.ids = np.concatenate([self.ids, ids])
            known = np.concatenate([self.known, different[new]])
            rank = np.argsort(known, kind="stable")
            self.place = np.concatenate([self.place, len(self.place) + np.arange(len(new))])[rank]
            self.known = known[rank]
        where = self.place[np.searchsorted(self.known, different)][back]
        row = np.searchsorted(at, start, side="right") - 1
        count = self.count[where]
        ids = self.ids[ragged(self.first[where], count)]
        per = np.bincount(row, count, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)]), np.bincount(row, self.score[where], minlength=len(texts))


def _lists(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, pa.int32()))


def _encode(key: _Key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                encoder = encoder or _Encoder(_lattice(key))
                ids, cuts, score = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(score), _lists(ids, cuts)],
                    names=["doc_id", "text", "score", "ids"])
    return run


def _cut(size: int, ahead: int, lead: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                text = lead + r["text"]
                for a in range(0, len(text), 64 * size):
                    k = range(a, min(len(text), a + 64 * size), size)
                    yield batch_of(CHUNKS, [r["row"]] * len(k), [x // size for x in k],
                                   [text[x:x + size] for x in k], [text[x + size:x + size + ahead] for x in k])
    return run


def _points(r) -> np.ndarray:
    points = code_points(r["body"] + r["ahead"]).copy()
    points[points == 0x20] = SPACE
    return points


def _groups(batch: pa.RecordBatch, characters: int = 1 << 17):
    """Rows of chunks that are solved together: what their tables need is bounded."""
    rows, width = [], 0
    for r in batch.to_pylist():
        width = max(width, len(r["body"]))
        if rows and width * (len(rows) + 1) > characters:
            yield rows
            rows, width = [], len(r["body"])
        rows.append(r)
    if rows:
        yield rows


def _transfer(key: _Key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lattice = _lattice(key)
            for rows in _groups(batch):
                matrices = lattice.transfer([_points(r) for r in rows], [len(r["body"]) for r in rows])
                yield batch_of(MATRICES, [r["row"] for r in rows], [r["chunk"] for r in rows], [m.ravel() for m in matrices])
    return run


def _scan(frame):
    import pandas as pd

    frame = frame.sort_values("chunk").drop_duplicates("chunk")
    side = int(round(len(frame.matrix.iloc[0]) ** 0.5))
    states = boundary_states([np.asarray(m).reshape(side, side) for m in frame.matrix])
    return pd.DataFrame({"row": frame.row, "chunk": frame.chunk, "entry": states[:-1], "exit": states[1:]})


def _trace(key: _Key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lattice = _lattice(key)
            for rows in _groups(batch):
                points = [_points(r) for r in rows]
                traced = lattice.trace(points, [len(r["body"]) for r in rows], [r["entry"] for r in rows], [r["exit"] for r in rows])
                ids = [lattice.with_bytes(p, first, last, i)[0] for p, (first, last, i, _) in zip(points, traced)]
                yield batch_of(TRACED, [r["row"] for r in rows], [r["chunk"] for r in rows], [t[3] for t in traced], ids)
    return run


def encode(docs: DataFrame, model_file: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, score, ids of every row of ``docs`` (doc_id, text).

    ``giant`` and ``chunk`` decide only how a text is solved. Null and empty texts have no
    ids and score 0; a text keeps its null. Repeated rows are encoded each; null ids keep
    their rows; an empty table gives an empty table; other columns are not read.
    """
    key = _Key(Vocabulary.read(model_file))
    longest = max(len(p) for p, ok in zip(key.vocabulary.pieces, key.vocabulary.normal) if ok)
    chunk = max(chunk, longest)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spec = schema("doc_id bigint, text string, score double, ids array<int>")
    size = F.coalesce(F.length("text"), F.lit(0))
    usual = rows.where(size <= giant).mapInArrow(_encode(key), spec)
    # equal rows have one solution
    large = rows.where(size > giant).withColumn("row", F.xxhash64("doc_id", "text"))
    chunks = large.mapInArrow(_cut(chunk, longest, " " if key.vocabulary.lead else ""), CHUNKS).repartition("row", "chunk").dropDuplicates(["row", "chunk"])
    solved = chunks.mapInArrow(_transfer(key), MATRICES)
    # a text's matrices are smaller than the text, which was one row
    states = solved.groupBy("row").applyInPandas(_scan, STATES)
    traced = chunks.join(states, ["row", "chunk"]).mapInArrow(_trace(key), TRACED)
    whole = traced.groupBy("row").agg(
        F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    whole = whole.select("row", "score", F.flatten("parts.ids").alias("ids"))
    return usual.unionByName(large.join(whole, "row").select("doc_id", "text", "score", "ids"))


def _decode(key: _Key):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lattice = _lattice(key)
            lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            cuts = lists.offsets.to_numpy().astype(np.int64)
            step = 2000
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                ids = lists.values.to_numpy()[cuts[a]:cuts[b]]
                data, ends = lattice.decode(ids, cuts[a:b + 1] - cuts[a])
                raw = data.tobytes()
                out = [raw[x:y].decode("utf-8", "replace") for x, y in zip(ends.tolist(), ends[1:].tolist())]
                if lattice.lead:
                    out = [t.removeprefix(" ") for t in out]
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.string())], [*rest.schema.names, "decoded"])
    return run


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` with a column decoded: the text of the column ids; null ids are ''."""
    from pyspark.sql import types as T

    key = _Key(Vocabulary.read(model_file))
    return encoded.mapInArrow(_decode(key), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
