"""Toxicity by a support vector machine over a gapped subsequence kernel of words.

* Kernel. k(u, v) sums, over all letter triples that both strings hold in order inside
  ``SPAN`` characters, decay ** (their extents); it is normalised, and sharpened to
  exp(-sharpness * (1 - k)), which is again a kernel. Inserted characters only lengthen the
  extents ("id-iot", "i d i o t"); runs of one-letter words count as one string. A letter
  put inside ("idxiot") also adds triples of its own, which the sharpening would not forgive:
  a string between ``LEAST`` and ``ALIKE`` is taken without the inner letters, at most
  ``INSERTED`` of them, whose loss brings it nearest to a landmark.
* Landmarks are words that labelled texts of class 1 use and others do not. A sentence is
  described by its words' greatest kernel value at each landmark, mapped by the Nystroem
  transform K_mm ** -1/2, and scored by a linear machine trained on labelled sentences:
  of class 0 all sentences are negative, of class 1 the sentence with the strongest word is
  positive. A text's score is a sigmoid of its worst sentence's margin and of the number of
  sentences on the positive side (Platt scaling with two inputs).
* Triples of a string are looked up in an inverted list of the landmarks' triples, so a string
  costs what its triples share with landmarks; strings seen before in a task are not redone.

The machine is fitted on at most ``sample`` labelled rows of each class, those with the least
hash of their id. Their sentences stay in a table: each Newton step of the squared hinge loss
is one job whose tasks send a matrix of landmarks x landmarks, and the driver holds one
sentence per text of class 1. Every text is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import U64, PrefixHash, batch_of, bucket_of, ragged, schema, slices, stored, utf8, words

SPAN, DECAY, SHARPNESS, FLOOR = 9, 0.7, 8.0, 0.1
#: Kernel values before sharpening: of a near string, and of a four-letter word with a letter put inside.
NEAR, LEAST = 1 + np.log(FLOOR) / SHARPNESS, 0.48
#: From here on a string is taken as it is.
ALIKE = 0.97
INSERTED, LONGEST = 2, 24
SLICE = 1 << 20
#: Strings remembered by a task before it forgets them.
REMEMBERED = 400_000
LETTERS = 32
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SEEN = schema("doc bigint, word string")
SCORED = schema("doc_id bigint, score double")
BAGS = schema("doc bigint, label int, vector array<double>")
STRONGEST = schema("doc bigint, strength double, vector array<double>")
MARGINS = schema("doc bigint, label int, margin double")
SUMS = schema("loss double, count bigint, products binary")


def _classes() -> np.ndarray:
    """Byte to letter: a-z are 1 to 26, other scripts 27 to 31 by their last byte, 0 is a gap."""
    table = np.zeros(256, np.int64)
    for k in range(26):
        table[65 + k] = table[97 + k] = k + 1
    for digit, letter in LEET.items():
        table[ord(digit)] = table[ord(letter)]
    table[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 0x1F) % 5
    return table


CLASS = _classes()
BREAK = np.zeros(256, bool)
BREAK[[*b".!?\n"]] = True


def units(flat: np.ndarray, at: np.ndarray):
    """Strings of a slice: the words and the runs of three or more one-letter words.

    Returns start, end, row, sentence (numbered through the slice).
    """
    start, end, row = words(flat, at)
    if not len(start):
        return start, end, row, start
    full = end
    for _ in range(4):  # marks around a word are not part of it
        end = end - ((end - start > 1) & (CLASS[flat[end - 1]] == 0))
        start = start + ((end - start > 1) & (flat[start] < 0x80) & (CLASS[flat[start]] == 0))
    # a sentence ends with a mark or a line end between two words, or with the text
    marks = np.concatenate([[0], np.cumsum(BREAK[flat])])
    stop = np.zeros(len(start), bool)
    stop[1:] = (row[1:] != row[:-1]) | (
        (marks[start[1:]] - marks[end[:-1]] > 0) & (full[:-1] - start[:-1] > 1))
    sentence = np.cumsum(stop)
    single = end - start == 1
    single &= CLASS[flat[start]] > 0
    turn = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
    a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    cut = (b - a >= 3) & (row[np.minimum(a, len(row) - 1)] == row[b - 1])
    a, b = a[cut], b[cut]
    return (np.concatenate([start, start[a]]), np.concatenate([end, end[b - 1]]),
            np.concatenate([row, row[a]]), np.concatenate([sentence, sentence[a]]))


def triples(flat: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(string, triple, weight) of each ordered letter triple inside SPAN characters."""
    # the first byte of a two-byte letter takes no room
    sizes = end - start
    data = flat[ragged(start, sizes)]
    string = np.repeat(np.arange(len(start)), sizes)
    keep = data < 0xC0
    letter, string = CLASS[data[keep]], string[keep]
    who, what, weight = [], [], []
    n = len(letter)
    for far in range(2, SPAN):
        first = np.flatnonzero((string[far:] == string[:-far]) & (letter[:-far] > 0) & (letter[far:] > 0)) if n > far else np.zeros(0, np.int64)
        if not len(first):
            continue
        outer = letter[first] * LETTERS * LETTERS + letter[first + far]
        for mid in range(1, far):
            middle = letter[first + mid]
            ok = middle > 0
            who.append(string[first[ok]])
            what.append((outer[ok] + middle[ok] * LETTERS).astype(np.int32))
            weight.append(np.full(len(what[-1]), DECAY ** (far - 2), np.float32))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(who), np.concatenate(what), np.concatenate(weight)


def features(flat, start, end):
    """Triples of each string summed, sorted by string, divided by the string's norm."""
    who, what, weight = triples(flat, start, end)
    key = who * LETTERS**3 + what
    rank = np.argsort(key, kind="stable")
    key, weight = key[rank], weight[rank]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    total = np.add.reduceat(weight, first) if len(first) else weight
    key = key[first]
    who, what = key // LETTERS**3, key % LETTERS**3
    norm = np.sqrt(np.bincount(who, total.astype(np.float64) ** 2, minlength=len(start)))
    return who, what, total / norm[who] if len(who) else total


@dataclass(frozen=True)
class Landmarks:
    table: np.ndarray  # triple x landmark, unit columns
    whiten: np.ndarray  # K_mm ** -1/2
    starts: np.ndarray  # of each triple's entries in the inverted list
    holder: np.ndarray  # landmark of an entry
    held: np.ndarray  # its value

    @classmethod
    def of(cls, strings: list[str]) -> Landmarks:
        flat, at = utf8(pa.array(strings, pa.string()))
        who, what, value = features(flat, at[:-1], at[1:])
        table = np.zeros((LETTERS**3, len(strings)), np.float32)
        table[what, who] = value
        kernel = np.exp(-SHARPNESS * (1 - table.T.astype(np.float64) @ table))
        values, vectors = np.linalg.eigh(kernel)
        whiten = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        triple, holder = np.nonzero(table)
        starts = np.concatenate([[0], np.cumsum(np.bincount(triple, minlength=LETTERS**3))])
        return cls(table, whiten, starts, holder, table[triple, holder].astype(np.float64))

    def kernel(self, flat, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Strings near a landmark and their kernel values; all others are below FLOOR."""
        parts = [self._kernel(flat, start[a:a + 4096], end[a:a + 4096]) for a in range(0, len(start), 4096)]
        who = np.concatenate([w + 4096 * k for k, (w, _) in enumerate(parts)]) if parts else np.zeros(0, np.int64)
        return who, np.concatenate([v for _, v in parts]) if parts else np.zeros((0, self.table.shape[1]), np.float32)

    def _kernel(self, flat, start, end) -> tuple[np.ndarray, np.ndarray]:
        who, near = self._near(flat, start, end)
        top, size = near.max(axis=1, initial=0), (end - start)[who]
        some = np.flatnonzero((top >= LEAST) & (top < ALIKE) & (size > 4) & (size <= LONGEST))
        for a in range(0, len(some), 128):  # bounds the versions
            own = some[a:a + 128]
            near[own] = self._without_inserted(flat, start[who[own]], end[who[own]], near[own])
        keep = near.max(axis=1, initial=0) >= NEAR
        values = np.exp(-SHARPNESS * (1 - near[keep]))
        values[values < FLOOR] = 0
        return who[keep], values

    def _near(self, flat, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Strings that may reach LEAST, with their kernel values before sharpening."""
        who, what, value = features(flat, start, end)
        count = self.starts[what + 1] - self.starts[what]
        # only strings that share enough weight with any landmark can be near one
        mass = np.bincount(who, np.where(count > 0, value.astype(np.float64) ** 2, 0), minlength=1)
        hit = (count > 0) & (np.sqrt(mass)[who] >= LEAST)
        who, what, value, count = who[hit], what[hit], value[hit], count[hit]
        width = self.table.shape[1]
        if not len(who):
            return np.zeros(0, np.int64), np.zeros((0, width), np.float32)
        new = np.concatenate([[True], who[1:] != who[:-1]])
        string = np.cumsum(new) - 1
        entry = ragged(self.starts[what], count)
        near = np.bincount(np.repeat(string, count) * width + self.holder[entry],
                           np.repeat(value, count) * self.held[entry], minlength=(string[-1] + 1) * width)
        return who[new], near.reshape(-1, width).astype(np.float32)

    def _without_inserted(self, flat, start, end, near) -> np.ndarray:
        """Kernel values of the strings without the inner letters that keep them from a landmark."""
        near, own = near.copy(), np.arange(len(start))
        for _ in range(INSERTED):
            size = end - start
            count = size - 2
            string = np.repeat(np.arange(len(own)), count)
            gone = ragged(np.ones(len(own), np.int64), count)
            place = ragged(np.zeros(len(string), np.int64), size[string])
            keep = place != np.repeat(gone, size[string])
            flat = flat[(np.repeat(start[string], size[string]) + place)[keep]]
            edge = np.concatenate([[0], np.cumsum(size[string] - 1)])
            version, values = self._near(flat, edge[:-1], edge[1:])
            # the best version of each string, the first one of equals
            order = np.lexsort((version, -values.max(axis=1, initial=0), string[version]))
            head = np.ones(len(order), bool)
            head[1:] = string[version][order][1:] != string[version][order][:-1]
            best = order[head]
            better = values[best].max(axis=1, initial=0) > near[own[string[version[best]]]].max(axis=1, initial=0)
            best = best[better]
            which = own[string[version[best]]]
            near[which] = values[best]
            more = (values[best].max(axis=1, initial=0) < ALIKE) & (size[string[version[best]]] > 5)
            own, start, end = which[more], edge[version[best]][more], edge[version[best] + 1][more]
            if not len(own):
                break
        return near


class Describer:
    """Sentence vectors of slices; remembers the strings it has met."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, U64)
        self.place = np.zeros(0, np.int64)  # row in values, -1: near no landmark
        self.values = np.zeros((0, self.landmarks.table.shape[1]), np.float32)

    def sentences(self, flat, at) -> tuple[np.ndarray, np.ndarray]:
        """(row, vector) of each sentence that has a string near a landmark."""
        start, end, row, sentence = units(flat, at)
        if not len(start):
            return row, self.values[:0]
        h = PrefixHash(CLASS[flat].astype(np.uint8)).of(start, end) ^ (end - start).astype(U64)
        different, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        spot = np.searchsorted(self.known, different)
        old = np.zeros(len(different), bool)
        inside = spot < len(self.known)
        old[inside] = self.known[spot[inside]] == different[inside]
        new = np.flatnonzero(~old)
        if len(new):
            who, values = self.landmarks.kernel(flat, start[first[new]], end[first[new]])
            place = np.full(len(new), -1)
            place[who] = len(self.values) + np.arange(len(who))
            self.values = np.concatenate([self.values, values])
            known = np.concatenate([self.known, different[new]])
            rank = np.argsort(known, kind="stable")
            self.known, self.place = known[rank], np.concatenate([self.place, place])[rank]
        value = self.place[np.searchsorted(self.known, different)][back]
        hit = np.flatnonzero(value >= 0)
        if not len(hit):
            return row[:0], self.values[:0]
        hit = hit[np.argsort(sentence[hit], kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], sentence[hit][1:] != sentence[hit][:-1]]))
        return row[hit][edge], np.maximum.reduceat(self.values[value[hit]], edge, axis=0)


@dataclass(frozen=True)
class Machine:
    landmarks: tuple[str, ...]
    weights: np.ndarray
    bias: float
    slopes: tuple[float, float]
    offset: float

    def scorer(self):
        describer = Describer(Landmarks.of(list(self.landmarks)))
        weights = describer.landmarks.whiten @ self.weights

        def evidence(flat, at) -> np.ndarray:
            row, vector = describer.sentences(flat, at)
            return document_evidence(row, vector @ weights + self.bias, len(at) - 1, self.bias)

        return evidence

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(evidence @ self.slopes + self.offset), -700, 700)))


def document_evidence(row, margin, rows: int, bias: float) -> np.ndarray:
    """Per text: the greatest margin of a sentence, log(1 + sentences with a positive one)."""
    most, count = np.full(rows, bias), np.zeros(rows)
    np.maximum.at(most, row, margin)
    np.add.at(count, row, margin > 0)
    return np.column_stack([most, np.log1p(count)])


# Fitting --------------------------------------------------------------------------------

def _string(flat, start, end) -> str:
    return flat[start:end].tobytes().decode("utf-8", "replace").lower().strip(".,;:!?\"'()")


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            doc = batch.column("doc").to_pylist()
            flat, at = utf8(batch.column("text"))
            start, end, row, _ = units(flat, at)
            pairs = {(r, _string(flat, a, b)) for r, a, b in zip(row.tolist(), start.tolist(), end.tolist())}
            pairs = sorted(p for p in pairs if 3 <= len(p[1]) <= 40)
            yield batch_of(SEEN, [doc[r] for r, _ in pairs], [w for _, w in pairs])


def _bags(strings: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(Landmarks.of(strings))
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                row, vector = describer.sentences(*utf8(batch.column("text")))
                label = batch.column("label").to_numpy()[row]
                doc = batch.column("doc").to_numpy()[row]
                yield batch_of(BAGS, doc, label, vector.tolist())
    return run


def _strongest(whiten: np.ndarray, weights: np.ndarray | None):
    """Each batch's strongest sentence of a text: by its margin, before there is one by its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, x = batch.column("doc").to_numpy(), _matrix(batch, len(whiten))
            strength = np.linalg.norm(x @ whiten, axis=1) if weights is None else x @ (whiten @ weights[:-1])
            order = np.lexsort((*x.T, -strength, doc))
            head = np.ones(len(order), bool)
            head[1:] = doc[order][1:] != doc[order][:-1]
            best = order[head]
            yield batch_of(STRONGEST, doc[best], strength[best], batch.column("vector").take(pa.array(best)))
    return run


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _hinge_sums(whiten: np.ndarray, weights: np.ndarray):
    """Sums of a task over sentences of class 0 that cost something: loss, vectors, their products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(whiten)
        loss, rows, products = 0.0, 0, np.zeros((width + 1, width + 1))
        for batch in batches:
            x = _matrix(batch, width)
            slack = np.maximum(0, 1 + x @ (whiten @ weights[:-1]) + weights[-1])
            x = np.column_stack([x, np.ones(len(x))])[slack > 0]
            loss, rows, products = loss + float(slack @ slack), rows + batch.num_rows, products + x.T @ x
        yield batch_of(SUMS, [loss], [rows], [products.tobytes()])
    return run


def newton(negative: DataFrame, positive: np.ndarray, whiten: np.ndarray, start: np.ndarray | None,
           ridge: float = 1e-3, steps: int = 12) -> np.ndarray:
    """Least squared hinge loss plus ridge; the last weight is the bias.

    ``positive`` holds whitened sentences of class 1, ``negative`` a table of sentences of class
    0, to which one like no landmark is added. Both classes have half of all weight. A step
    that raises the loss is halved.
    """
    width = len(whiten)
    turn = np.eye(width + 1)
    turn[:width, :width] = whiten
    x = np.column_stack([positive, np.ones(len(positive))])
    w = np.zeros(width + 1) if start is None else start
    before, least = None, np.inf
    for _ in range(steps):
        parts = negative.mapInArrow(_hinge_sums(whiten, w), SUMS).collect()
        count = sum(p["count"] for p in parts) + 1
        products = sum((np.frombuffer(p["products"]).reshape(width + 1, width + 1) for p in parts), np.zeros_like(turn))
        blank = max(0.0, 1 + w[-1])
        products[-1, -1] += blank > 0
        products = turn.T @ products @ turn / (2 * count)
        slack = np.maximum(0, 1 - x @ w)
        active = x[slack > 0]
        share = 1 / (2 * max(1, len(x)))
        loss = (sum(p["loss"] for p in parts) + blank ** 2) / (2 * count) + share * float(slack @ slack) + ridge / 2 * float(w @ w)
        if loss > least + 1e-12:
            w = (w + before) / 2
            continue
        if least - loss < 1e-9:
            break
        # the bias is a column of ones, so the last column of the products is the vectors' sum
        hessian = 2 * (products + share * active.T @ active) + ridge * np.eye(width + 1)
        before, least = w, loss
        w = np.linalg.solve(hessian, 2 * (share * active.sum(axis=0) - products[:, -1]))
    return before


def _margins(whiten: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _matrix(batch, len(whiten)) @ (whiten @ weights[:-1]) + weights[-1]
            yield batch_of(MARGINS, batch.column("doc"), batch.column("label"), margin)
    return run


def platt(inputs: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Slopes and, last, offset of the sigmoid by Newton steps, with Platt's smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([inputs, np.ones(len(inputs))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - target) + 0.1 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, sample: int = 3000,
        landmarks: int = 160) -> Machine:
    """A machine fitted on labelled rows whose id's crc32 modulo ``folds`` is not 0.

    ``sample`` bounds the labelled rows of each class that are read. With no row of a class
    the machine scores every text alike, by the share of class 1.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (bucket_of(F.col("doc_id"), folds) != 0)).select(
        F.col("doc_id").cast("long").alias("doc"), F.col(label).cast("int").alias("label")).distinct()
    shares = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    everyone = sum(shares.values())
    base = Machine((), np.zeros(0), 0.0, (0.0, 0.0), float(np.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1))))
    if len(shares) < 2 or not everyone:
        return base
    chosen = [usable.where(F.col("label") == k).orderBy(F.xxhash64("doc"), "doc").limit(sample) for k in (0, 1)]
    # at most 2 * sample ids, so the broadcast is bounded
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), "doc")
    texts = texts.select("doc", "text", "label").repartition(24, "doc").cache()
    try:
        n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.countDistinct("doc").alias("n")).collect()}
        if len(n) < 2:
            return base
        seen = texts.mapInArrow(_document_words, SEEN).distinct().join(texts.select("doc", "label").distinct(), "doc")
        counts = seen.groupBy("word").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("all"))
        rate = (F.col("p") + 0.1) / (n[1] + 1)
        other = (F.col("all") - F.col("p") + 0.5) / (n[0] + 1)
        told = counts.where("p >= 3").withColumn("told", F.col("p") * F.log(rate / other)).where(rate > 12 * other)
        strings = [r["word"] for r in told.orderBy(F.desc("told"), "word").limit(landmarks).collect()]
        if not strings:
            return base
        bags = stored(texts.mapInArrow(_bags(strings), BAGS), "toxicity-sentences")
        labelled = texts.select("doc", "label").distinct().toPandas().sort_values(["doc", "label"])
    finally:
        texts.unpersist()
    whiten = Landmarks.of(strings).whiten
    negative, positive = (bags.where(F.col("label") == k).coalesce(24) for k in (0, 1))
    w, picked = None, None
    for _ in range(4):
        # one sentence of each of at most ``sample`` texts
        best = positive.mapInArrow(_strongest(whiten, w), STRONGEST).groupBy("doc").agg(
            F.max(F.struct("strength", "vector")).alias("best")).select("doc", "best.vector").toPandas().sort_values("doc")
        x = np.vstack([*best.vector, np.zeros((0, len(strings)))])
        if picked is not None and np.array_equal(picked, x):
            break
        picked = x
        w = newton(negative, x @ whiten, whiten, w)
    margins = bags.mapInArrow(_margins(whiten, w), MARGINS).groupBy("doc", "label").agg(
        F.max("margin").alias("most"), F.sum((F.col("margin") > 0).cast("long")).alias("count")).toPandas()
    found = labelled.merge(margins, "left", ["doc", "label"])
    evidence = np.column_stack([
        np.maximum(found["most"].fillna(-np.inf).to_numpy(), w[-1]), np.log1p(found["count"].fillna(0).to_numpy(np.float64))])
    *slopes, offset = platt(evidence, labelled.label.to_numpy() * 2 - 1)
    # the classes were sampled apart: back to their shares among the labelled rows
    offset += float(np.log(shares[1] / shares[0]) - np.log(n[1] / n[0]))
    return Machine(tuple(strings), w[:-1], float(w[-1]), tuple(map(float, slopes)), float(offset))


def _scored(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = machine.scorer() if machine.landmarks else None
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                flat, at = utf8(batch.column("text"))
                found = evidence(flat, at) if evidence else np.zeros((batch.num_rows, 2))
                yield batch_of(SCORED, batch.column("doc_id"), machine.score(found))
    return run


def _clean(machine: Machine, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = machine.scorer() if machine.landmarks else None
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = evidence(*utf8(batch.column("text"))) if evidence else np.zeros((batch.num_rows, 2))
                yield batch.filter(pa.array(machine.score(found) < threshold))
    return run


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below ``threshold``."""
    return docs.mapInArrow(_clean(machine, threshold), docs.schema)


def score(docs: DataFrame, machine: Machine, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    Null and empty texts get the score of a text with no string near a landmark; null ids
    keep their rows; repeated rows score alike; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(_scored(machine), SCORED)
    return scored.select(
        "doc_id", (bucket_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
