"""Personal data in texts, also in disguise, with spans of the text as it stands.

Plain identifiers are found by fixed patterns (``plain_spans``). Disguised ones are read on a
tape: the text rewritten by small transducers, each of which keeps for every character of its
output the span of the source it stands for. They undo look-alike and invisible characters,
words for "dot" and "at", letters in place of digits, and digits spelled as words. What the
patterns find on the tape maps back to source spans and is added where a disguise was undone
inside it, unless it cuts through a plain span of its kind.

Every pattern runs in time linear in the text: a run that cannot start a match is passed once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Plain identifiers ----------------------------------------------------------------------

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, read from each @ outwards, so long words without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def small(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + doubled) % 10 == 0


def numbers(text: str) -> Iterator[Span]:
    for m in ADDRESS.finditer(text):
        if all(map(small, m.group().split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group()) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            yield "phone", m.start(), m.end()


def plain_spans(text: str) -> list[Span]:
    """Identifiers as they stand: (kind, start, end) in code points, by kind as listed, then start."""
    found = list(emails(text))
    return found + list(numbers(text)) if DIGIT.search(text) else found


# Look-alikes of Latin letters, and words for digits and marks ---------------

LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "А": "A", "В": "B", "С": "C",
    "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "У": "Y", "З": "3",
    # Greek
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A",
    "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    # Armenian, Latin extensions, marks
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "L",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "•": ".", "∙": ".",
}
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
DOT_WORDS = "dot|d0t|point|punkt|punto|period"
AT_WORDS = "at|a[rR]roba|arobase|klammeraffe"
LETTERS_AS_DIGITS = str.maketrans("OoQIl|", "000111")


# Tapes ----------------------------------------------------------------------------------

class Tape:
    """A rewritten text; character k stands for source[start[k]:end[k]]."""

    def __init__(self, source: str):
        self.source = self.text = source
        self.start = np.arange(len(source))
        self.end = self.start + 1

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replace spans of the tape, given in order; each new character stands for its whole span."""
        text, start, end, last = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[last:a], new]
            start += [self.start[last:a], np.full(len(new), self.start[a])]
            end += [self.end[last:a], np.full(len(new), self.end[b - 1])]
            last = b
        if text:
            self.text = "".join([*text, self.text[last:]])
            self.start = np.concatenate([*start, self.start[last:]])
            self.end = np.concatenate([*end, self.end[last:]])

    def undone(self, a: int, b: int) -> bool:
        """Does the tape differ here from the source?"""
        return self.source[self.start[a]:self.end[b - 1]] != self.text[a:b]


@cache
def glyph(char: str) -> str:
    """The ASCII character a look-alike stands for; empty for invisible ones; else itself."""
    if unicodedata.category(char) == "Cf":
        return ""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    digit = unicodedata.digit(char, None)
    plain = unicodedata.normalize("NFKC", char) if digit is None else str(digit)
    return plain if len(plain) == 1 and plain.isascii() else char


# Outside of ASCII and Latin letters, where only blanks, a middle dot, raised digits and ı are look-alikes.
ODD = re.compile("[^\x00-\x9f\xa1-\xac\xae-\xb1\xb4-\xb6\xb8\xba-İĲ-ɏ]")


def undo_glyphs(tape: Tape) -> None:
    if not tape.text.isascii():
        found = ((m.start(), m.end(), glyph(m.group())) for m in ODD.finditer(tape.text))
        tape.rewrite(x for x in found if tape.text[x[0]:x[1]] != x[2])


OPEN, CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
DOT = re.compile(rf"(?i){OPEN}(?:\.|{DOT_WORDS}){CLOSE}|&#0*46;|&#x0*2e;|&period;|%2e|(?<![ _-])[ _-]{{1,4}}dot[ _-]{{1,4}}")
AT = re.compile(rf"(?i){OPEN}(?:@|{AT_WORDS}){CLOSE}|(?<=[a-z0-9])[\[({{]a[\])}}](?=[a-z0-9])|&#0*64;|&#x0*40;|&commat;|%40| @|@ ")
WIDE = re.compile(rf"[ ]{{1,3}}(?:(?i:{DOT_WORDS})[ ]{{1,3}}(?=[A-Za-z0-9])|\.[ ]{{1,3}}(?=[a-z0-9]))")
BARE = re.compile(r"(?i)(?<=[A-Za-z0-9])(?:[ ]{1,3}|[_-])(?:at|arroba|arobase)(?:[ ]{1,3}|[_-])(?=[A-Za-z0-9-]+(?:\.|[ ]{1,3}\w))")
# Quick signs of disguised marks in lower-cased text: few texts have one.
MARKS = ("dot", " @", "@ ", "%2e", "%40", "arroba", "arobase")
FRAMES = re.compile(r"[\[({<&](?:\s{0,3}[@.adkp]|[#cp])")
BARE_FRAME = re.compile(r"at[ _-]{1,3}[a-z0-9-]+(?:\.[a-z0-9]| p)")


def marked(pattern: re.Pattern, text: str, mark: str) -> Iterator[tuple[int, int, str]]:
    """Matches between two letters or digits, with the blanks around them."""
    last = 0
    for m in pattern.finditer(text):
        a, b = m.span()
        while a > last and text[a - 1] == " " and m.end() - a < 12:
            a -= 1
        while b < len(text) and text[b] == " " and b - m.start() < 20:
            b += 1
        if a > last and b < len(text) and text[a - 1].isalnum() and text[b].isalnum():
            yield a, b, mark
            last = b


def undo_marks(tape: Tape) -> None:
    """Brackets, escapes and words for . and @; bare words count only in the frame of an address."""
    low = tape.text.lower()
    if not any(mark in low for mark in MARKS) and not FRAMES.search(low) and not BARE_FRAME.search(low):
        return
    tape.rewrite(marked(DOT, tape.text, "."))
    tape.rewrite(marked(AT, tape.text, "@"))
    tape.rewrite(_bare_at(tape))
    tape.rewrite(_wide_dots(tape))


LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*+")


def _labels(text: str, at: int) -> int:
    m = LABELS.match(text, at)
    return m.end() if m else at


def _wide_dots(tape: Tape) -> Iterator[tuple[int, int, str]]:
    """In the domain after an @ that was disguised, any word for a dot and any spaced dot is one."""
    for at in re.finditer("@", tape.text):
        if tape.undone(*at.span()):
            end = _labels(tape.text, at.end())
            while m := WIDE.match(tape.text, end):
                yield *m.span(), "."
                end = _labels(tape.text, m.end())


def _bare_at(tape: Tape) -> Iterator[tuple[int, int, str]]:
    """A bare "at" is an @ if a dot of the domain is disguised, or a dotted domain follows a name with a digit or mark."""
    for m in BARE.finditer(tape.text):
        end = _labels(tape.text, m.end())
        start = m.start()
        while start and tape.text[start - 1] in LOCAL:
            start -= 1
        name, domain = tape.text[start:m.start()], tape.text[m.end():end]
        worded = WIDE.match(tape.text, end) if domain else None
        odd = re.search(r"[0-9._+%]", name) is not None
        foreign = m.group().strip(" _-").lower() != "at"
        if "." in domain and (odd or tape.undone(m.end(), end)) or worded and worded.group().strip() != "." and (odd or foreign):
            yield m.start(), m.end(), "@"


_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_BETWEEN = r"(?:[ ]{1,2}|[-.]|,[ ]?|[ ]-[ ]|[ ]?[()][ ]?)"
_TOKEN = rf"(?:(?:double|triple)[ ])?(?:{_WORD})|[0-9]{{1,4}}"
SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:{_TOKEN})(?:{_BETWEEN}(?:{_TOKEN}))+(?![^\W_])")
PIECES = re.compile(rf"(?i)((?:double|triple)[ ])?({_WORD})|([0-9]+)|([^A-Za-z0-9]+)")
#: Lower-cases ASCII and turns marks between words into blanks.
SPLITTER = bytes(32 if chr(b) in ",.:;()-@" else b + 32 if 65 <= b <= 90 else b for b in range(256))
DIGIT_BYTES = frozenset(w.encode() for w in DIGIT_WORDS) | {w.upper().encode().lower() for w in DIGIT_WORDS}
PLUS = re.compile(rf"(?i)(?<![^\W_])plus[ ]{{1,2}}(?=[0-9]|(?:{_WORD})(?![^\W_]))")
MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OoQIl|]*[0-9][0-9OoQIl|]*(?![A-Za-z0-9])")
LETTERED = re.compile(r"[OoQIl|][0-9]|[0-9][OoQIl|]")


def spells_digits(text: str) -> bool:
    """Does a digit word stand beside another or a number? Quick, so that few texts meet the slower pattern."""
    words = text.encode().translate(SPLITTER).split()
    if DIGIT_BYTES.isdisjoint(words):
        return False
    near = lambda k: 0 <= k < len(words) and (words[k] in DIGIT_BYTES or words[k].isdigit())
    return any(near(k - 2) or near(k - 1) or near(k + 1) or near(k + 2) for k, w in enumerate(words) if w in DIGIT_BYTES)


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """Digit words, and the blanks between two of them, where a run has two or numbers on both sides of one."""
    for run in SPELLED.finditer(text):
        parts = list(PIECES.finditer(text, run.start(), run.end()))
        word = [p.group(2) is not None for p in parts]
        if sum(word) < 2 and (word[0] or word[-1] or not any(word)):
            continue
        for k, p in enumerate(parts):
            if word[k]:
                times = {"d": 2, "t": 3}[p.group(1)[0].lower()] if p.group(1) else 1
                yield p.start(), p.end(), str(DIGIT_WORDS[p.group(2).lower()]) * times
            elif p.group(4) and p.group(4) != "." and 0 < k < len(parts) - 1 and word[k - 1] and word[k + 1]:
                yield p.start(), p.end(), ""


NUMBER_DOT = re.compile(rf"(?i)(?<=[0-9])[ ]{{1,3}}(?:\.|{DOT_WORDS})[ ]{{1,3}}(?=[0-9])")


def undo_digits(tape: Tape) -> None:
    if spells_digits(tape.text):
        tape.rewrite(_spelled(tape.text))
    if DIGIT.search(tape.text):
        tape.rewrite([(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(tape.text)])
        tape.rewrite([(m.start(), m.end(), "+") for m in PLUS.finditer(tape.text)])
        if LETTERED.search(tape.text):
            tape.rewrite([(a, a + 1, tape.text[a].translate(LETTERS_AS_DIGITS)) for m in MIXED.finditer(tape.text)
                          for a in range(*m.span()) if not tape.text[a].isdigit()])


def hidden_spans(text: str, plain: list[Span]) -> list[Span]:
    """Disguised identifiers: source spans that hold a disguise and cut through no plain span of their kind."""
    tape = Tape(text)
    for undo in (undo_glyphs, undo_marks, undo_digits):
        undo(tape)
    if tape.text == text:
        return []
    found = []
    for kind, a, b in plain_spans(tape.text):
        if not tape.undone(a, b) or kind == "email" and not re.search(r"\.[A-Za-z]{2,}$", tape.text[a:b]):
            continue
        start, end = int(tape.start[a]), int(tape.end[b - 1])
        met = [(s, e) for k, s, e in plain if k == kind and s < end and e > start]
        if all(start <= s and e <= end and (s, e) != (start, end) for s, e in met):
            found.append((kind, start, end))
    return found


# Tables ---------------------------------------------------------------------------------

_SPAN = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]
_SPANS = pa.list_(pa.struct(_SPAN))
SPANS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("plain", T.BooleanType())]))),
])


def all_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """Plain and hidden spans by kind as listed, then start and end."""
    plain = plain_spans(text or "")
    rows = [(*x, True) for x in plain] + [(*x, False) for x in hidden_spans(text or "", plain)]
    return sorted(rows, key=lambda x: (KINDS.index(x[0]), *x[1:3]))


def _find(batches):
    for batch in batches:
        spans = [[dict(zip(("kind", "start", "end", "plain"), s)) for s in all_spans(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, plain) of every row of ``docs``; code points, end exclusive.

    Null and empty texts have no spans; null ids and repeated rows keep their rows; an empty
    table gives none. Only doc_id and text are read, whatever other columns there are.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, SPANS)


def masked(text: str | None) -> str | None:
    """The text with every span as its kind in angle brackets; overlapping spans go as one."""
    if not text:
        return text
    out, last = [], 0
    for kind, start, end, _ in sorted(all_spans(text), key=lambda x: (x[1], -x[2])):
        if start >= last:
            out += [text[last:start], f"<{kind}>"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with the spans of ``text`` masked."""
    def mask(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(map(masked, batch.column(k).to_pylist()), batch.schema.field(k).type))
    return docs.mapInArrow(mask, docs.schema)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``find``: plain spans counted by kind and hashed, and all spans as text."""
    plain = F.filter("spans", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
