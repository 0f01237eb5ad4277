"""Spelling variants: words that differ by one letter, met in a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols. Every word sends its reduced form's one-edit
neighbourhood - each symbol left out, each symbol replaced - to the words whose reduced form
is one of these strings. A pair meets from one of its ends, so a replacement goes only to the
same or a later symbol, and an insertion is the other word's omission. The strings travel as
hashes of eight bytes, so a long word costs as many rows as it has letters, not their square;
a hash that two strings share only adds a candidate.

A candidate passes at once only if the letters that remain have the same counts in a second
hashing to classes; what passes is verified on the original words by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import LOWER, U64, batch_of, mix, powers, schema, stored

SYMBOLS = 8
#: Letter classes of the signature; each has four bits, counts are modulo 2**60.
CLASSES = 15
MASK = (1 << 4 * CLASSES) - 1
#: Lowest bits of the classes' counts: what one letter adds is one of them.
UNITS = sum(1 << 4 * k for k in range(CLASSES))
RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
LOWER_BYTES = LOWER.tobytes()
#: Characters counted at a time, and characters of distinct words that a task holds.
PIECE, HELD = 1 << 20, 1 << 23
#: Letters whose neighbours are made at a time.
BLOCK = 1 << 16

COUNTS = schema("word string, n bigint")
NEIGHBOURS = schema("key bigint, id bigint, rest bigint")
REDUCED = schema("key bigint, id bigint, letters bigint")


# Words ----------------------------------------------------------------------------------

def pieces(text: str) -> Iterator[str]:
    """The text in parts of about ``PIECE`` characters that no run crosses."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + PIECE)
        end = gap.end() if gap else len(text)
        yield text[start:end]
        start = end


def damaged(doc: str, run: str, divisor: int) -> str:
    """The run, or for one in ``divisor`` (document, run) pairs the run without one letter."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % divisor:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counter(divisor: int, min_length: int):
    def count(batches):
        held, size = Counter(), 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                for piece in pieces((text or "").encode().translate(LOWER_BYTES).decode()):
                    for run, n in Counter(RUN.findall(piece)).items():
                        word = damaged(doc, run, divisor)
                        if len(word) >= min_length:
                            size += 0 if word in held else len(word) + 100
                            held[word] += n
                    if size > HELD:
                        yield batch_of(COUNTS, list(held), list(held.values()))
                        held, size = Counter(), 0
        if held:
            yield batch_of(COUNTS, list(held), list(held.values()))
    return count


def vocabulary(docs: DataFrame, min_length: int, min_count: int, divisor: int) -> DataFrame:
    """(id, word, n) of every word of at least ``min_length`` letters and ``min_count`` occurrences."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    counts = texts.mapInArrow(word_counter(divisor, min_length), COUNTS)
    words = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return stored(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")


# Neighbours -----------------------------------------------------------------------------

def _spread(codes: np.ndarray, shift: int, n: int) -> np.ndarray:
    """A fixed hash of each code point to one of ``n`` values."""
    return ((codes.astype(U64) * U64(0x9E3779B1) & U64(0xFFFFFFFF)) >> U64(shift)) % U64(n)


_VALUE = mix(np.arange(1, SYMBOLS + 1, dtype=U64))


class Letters:
    """The letters of a batch's words end to end, with running sums of their hashes."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.end = np.cumsum(self.length)
        self.word = np.repeat(np.arange(len(words)), self.length)
        self.at = np.arange(len(codes)) - (self.end - self.length)[self.word]
        self.symbol = _spread(codes, 20, SYMBOLS).astype(np.int64)
        self.unit = U64(1) << (U64(4) * _spread(codes, 9, CLASSES))
        self.up, down = powers(int(self.length.max(initial=0)) + 1)
        self.step = down[1]
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(_VALUE[self.symbol] * self.up[self.at], dtype=U64, out=self.sums[1:])
        counts = np.zeros(len(codes) + 1, U64)
        np.cumsum(self.unit, dtype=U64, out=counts[1:])
        start = self.end - self.length
        self.hash = self.sums[self.end] - self.sums[start]
        self.letters = counts[self.end] - counts[start] & U64(MASK)


def keyed(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(h ^ (length.astype(U64) << U64(40)))


def reduced(batches):
    """Each word under the hash of its reduced form, with its letter counts."""
    for batch in batches:
        x = Letters(batch.column("word").to_pylist())
        yield batch_of(REDUCED, keyed(x.hash, x.length), batch.column("id"), x.letters)


def neighbourhoods(batches):
    """Each word under the hashes of its neighbours, with the counts of the letters that remain."""
    for batch in batches:
        x = Letters(batch.column("word").to_pylist())
        ids = batch.column("id").to_numpy()
        for a in range(0, len(x.word), BLOCK):
            i = np.arange(a, min(a + BLOCK, len(x.word)))
            word = x.word[i]
            rest = x.letters[word] - x.unit[i] & U64(MASK)
            start = (x.end - x.length)[word]
            out = (x.sums[i] - x.sums[start]) + (x.sums[x.end[word]] - x.sums[i + 1]) * x.step
            yield batch_of(NEIGHBOURS, keyed(out, x.length[word] - 1), ids[word], rest)
            for by in range(SYMBOLS):
                j = np.flatnonzero(x.symbol[i] <= by)
                k, w = i[j], word[j]
                other = x.hash[w] + (_VALUE[by] - _VALUE[x.symbol[k]]) * x.up[x.at[k]]
                yield batch_of(NEIGHBOURS, keyed(other, x.length[w]), ids[w], rest[j])


def one_letter_apart(rest: Column, letters: Column) -> Column:
    """Are the counts ``letters`` those of ``rest``, or of ``rest`` and one letter more?"""
    more = (letters - rest).bitwiseAND(F.lit(MASK))
    return (more == 0) | ((F.bit_count(more) == 1) & (more.bitwiseAND(F.lit(UNITS)) != 0))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words (a, b) that differ by one inserted, deleted or replaced letter, once each."""
    made = words.select("id", "word").mapInArrow(neighbourhoods, NEIGHBOURS).alias("m")
    met = words.select("id", "word").mapInArrow(reduced, REDUCED).alias("r")
    pairs = made.join(met, (F.col("m.key") == F.col("r.key")) & (F.col("m.id") != F.col("r.id"))
                      & one_letter_apart(F.col("m.rest"), F.col("r.letters"))).select(
        F.least("m.id", "r.id").alias("a"), F.greatest("m.id", "r.id").alias("b")).distinct()
    left = words.select(F.col("id").alias("a"), F.col("word").alias("a_word"), F.col("n").alias("a_n"))
    right = words.select(F.col("id").alias("b"), F.col("word").alias("b_word"), F.col("n").alias("b_n"))
    return pairs.join(left, "a").join(right, "b").where(F.levenshtein("a_word", "b_word", 1) == 1)


# Forms and roots ------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of every word with a form: the last word of its chain.

    A form occurs ``ratio`` times as often as its word, so chains are short; each round
    doubles the steps that were followed and ends when no word moved.
    """
    links = forms.select("id", F.col("form_id").alias("root"))
    while True:
        onward = links.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = stored(links.join(onward, "root", "left").select(
            "id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        links = step.select("id", "root")
        if step.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5,
             divisor: int = 199) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters of the whole texts, lower-cased in A-Z only, with one letter
    left out where ``divisor`` divides the hash of document and run. ``form`` is the most
    frequent word one letter away (ties: the least in code-point order) if it occurs at least
    ``ratio`` times as often, else null; ``root`` follows forms to the last word. ``ratio``
    must be over 1, so chains end.

    Null and empty texts have no words; a null id counts as empty text in the hash; repeated
    rows count each time; an empty table gives no rows. Only doc_id and text are read, whatever
    other columns ``docs`` has.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = vocabulary(docs, min_length, min_count, divisor)
    pairs = stored(near_pairs(words), "spelling-pairs")
    near = pairs.selectExpr("a AS id", "b AS near_id", "b_word AS near_word", "b_n AS near_n").unionByName(
        pairs.selectExpr("b AS id", "a AS near_id", "a_word AS near_word", "a_n AS near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near_word").alias("word"), F.col("near_id").alias("id")))
    counted = near.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(counted, "id", "left").withColumn("is_variant", -F.col("best.n") >= ratio * F.col("n")).select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("is_variant"), F.col("best.word")).alias("form"),
        F.when(F.col("is_variant"), F.col("best.id")).alias("form_id"),
        F.when(F.col("is_variant"), -F.col("best.n")).alias("form_n"))
    rows = stored(rows, "spelling-forms")
    last = roots(rows.where("form_id IS NOT NULL")).join(
        words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return rows.join(last, "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
