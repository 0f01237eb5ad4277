"""Spelling variants, personal data and importance resampling against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from liftgrid.llm import importance, oracles, private_data, queries, spelling
from workload.compare import canonical_rows, connect

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
SCHEMA = "doc_id long, text string, word string, id long, spans int, n_words int, rank string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, "r", 4) for i, t in rows], SCHEMA).repartition(3)


def texts_of(spark, folder=SMALL):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(oracles.all_oracles()))
def test_queries_equal_their_twins(spark, name):
    df = queries.all_queries()[name](spark, SMALL)
    cursor = connect(SMALL).execute(oracles.all_oracles()[name])
    assert canonical_rows(df.columns, df.collect()) == canonical_rows([c[0] for c in cursor.description], cursor.fetchall())


# Spelling variants ----------------------------------------------------------------------

def brute_variants(rows, min_length=6, min_count=5, ratio=5, divisor=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1:] if h % divisor == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, found = {}, {}
    for w, n in words.items():
        found[w] = [x for x in words if near(w, x)]
        best = min(found[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(found[w]), words.get(form[w])) for w, n in words.items()}


def variants_of(spark, rows, **settings):
    found = spelling.variants(frame(spark, rows), **settings).collect()
    assert len(found) == len(set(found))
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


ODD_WORDS = [
    (1, None), (2, ""), (None, "abcdef " * 30), (3, "abcdeX abcde abcdef× ÷÷÷÷÷÷ " * 6), (4, "Abcdéf ABCDÉF " * 150),
    (4, "Abcdéf ABCDÉF " * 150), (5, "abcdeffg " * 6 + "bcdef abcdefg " * 8), (6, "aaaaaa aaaaaaa aaaaaaaa " * 9),
    (7, ("x" * 3000 + " ") * 5 + ("x" * 2999 + " ") * 25), (8, "abcdfe " * 7 + "acbdef " * 7), (9, "😀abcdef😀 один двадцать " * 5),
]


def test_variants_of_odd_texts(spark):
    assert variants_of(spark, ODD_WORDS) == brute_variants(ODD_WORDS)
    assert variants_of(spark, ODD_WORDS, min_length=1, min_count=1, ratio=2, divisor=2) == brute_variants(ODD_WORDS, 1, 1, 2, 2)
    assert variants_of(spark, []) == set()
    with pytest.raises(ValueError):
        spelling.variants(frame(spark, []), ratio=1)


def test_chains_of_forms_end_at_their_root(spark):
    rows = [(None, " ".join(w for k in range(6) for w in ["q" * (6 + k)] * 3 ** k))]
    found = {w: r for w, _, r, *_ in variants_of(spark, rows, min_count=1, ratio=3, divisor=1 << 40)}
    assert found == {"q" * (6 + k): "q" * 11 for k in range(6)}


def test_every_edit_meets_in_the_reduced_alphabet(spark):
    rng = random.Random(11)
    words = {"".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(2, 9))) for _ in range(60)}
    for w in list(words):
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1:], w[:k] + "z" + w[k:], w[:k] + "é" + w[k + 1:]}
    rows = [(k, w) for k, w in enumerate(sorted(words))]
    settings = {"min_length": 1, "min_count": 1, "ratio": 2, "divisor": 1 << 40}
    assert variants_of(spark, rows, **settings) == brute_variants(rows, 1, 1, 2, 1 << 40)


def test_counters_flush_without_changing_counts(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(spelling, "HELD", 300)
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "alpha beta gamma delta epsilon zeta eta theta " * 20
    batch = pa.RecordBatch.from_pydict({"doc": ["1", "2"], "text": [text, None]})
    got = Counter()
    parts = list(spelling.word_counter(1 << 40, 1)([batch]))
    for part in parts:
        got.update(dict(zip(part.column("word").to_pylist(), part.column("n").to_pylist())))
    assert len(parts) > 1 and got == Counter(text.split())


# Personal data --------------------------------------------------------------------------

def brute_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return found


PARTS = st.sampled_from(["a", "@", ".", "1", "12", "255", "256", "0", " ", "-", "+", "(", ")", "_", "é", "x.y", "4111111111111111", "\n", "٣"])


@given(st.lists(PARTS, max_size=30).map("".join))
@settings(max_examples=500, deadline=None)
def test_plain_spans_are_those_of_the_patterns(text):
    assert private_data.plain_spans(text) == brute_spans(text)


def test_plain_spans_of_the_documents(spark):
    for _, text in texts_of(spark):
        assert private_data.plain_spans(text or "") == brute_spans(text or "")


DISGUISED = {
    "email": [
        "john.smith [at] example [dot] com", "a.34 at mail7 dot example dot com", "a.34 (at) mail7.example.com", "a.34＠mail7．example．com",
        "jоhn.smith@exаmple.com", "john at example dot com", "john dot smith at example dot com", "user&#64;example&#46;com",
        "user_at_example_dot_com", "user AT example DOT com", "klaus(at)firma(punkt)de", "juan arroba correo punto es",
        "j.doe{at}mail{dot}org", "a.34 @ mail7 . example . com", "a.34[@]mail7[.]example[.]com", "a.34 at mail7.example.com",
        "a.34​@mail7.exa­mple.com", "a.34(a)mail7.example.com", "a dot three four at mail7 dot example dot com",
    ],
    "ip": [
        "129[.]38[.]82[.]176", "129 dot 38 dot 82 dot 176", "129(dot)38(dot)82(dot)176", "１２９.38.82.176", "١٢٩.٣٨.٨٢.١٧٦",
        "one two nine dot three eight dot eight two dot one seven six", "one dot two dot three dot four",
        "129 . 38 . 82 . 176", "129 point 38 point 82 point 176", "eins zwei neun punkt drei acht punkt acht zwei punkt eins sieben sechs",
        "129.38.eight two.176", "①②⑨.38.82.176", "129.38.82.¹⁷⁶",
    ],
    "card": [
        "4845–1681–1440–7329", "４８４５１６８１１４４０７３２９", "4845​168114407329",
        "four eight four five one six eight one one four four zero seven three two nine",
        "quatre huit quatre cinq un six huit un un quatre quatre zéro sept trois deux neuf",
        "vier acht vier fünf eins sechs acht eins eins vier vier null sieben drei zwei neun", "4845 I68l 144O 7329", 
        "4845 1681 14 four zero 7329", "4845 168 one 1440 7329",
    ],
    "phone": [
        "+1 four one five five five five seven seven one three", "plus one (four one five) 555-7713", "+1 (O17) 555-77l3", "+١ (٤١٥) ٥٥٥-٧٧١٣",
        "＋1 (415) 555‑7713", "plus 1 415 555 7713", "+1 four one five triple five 7713", "+1 (415) 555-seven seven one three",
        "plus one, four one five, five five five, seven seven one three",
    ],
}


@pytest.mark.parametrize("kind", DISGUISED)
def test_disguises_are_read_where_they_stand(kind):
    for disguised in DISGUISED[kind]:
        for before, after in (("", ""), ("Ça va: ", ", then"), ("😀 see ", "\nNext")):
            text = before + disguised + after
            hidden = [(k, text[a:b]) for k, a, b, plain in private_data.all_spans(text) if not plain]
            assert hidden == [(kind, disguised)], text


def test_clean_texts_stay_clean():
    for text in (
        "a at b. Look at this at home.Next", "zero zero one two", 'token = "c1e4c9030b2fad02edf9e9b50afc6bbc"', "The dot. At noon (at last) it is.",
        "one or two, three at most", "un deux trois", "1 at 2.50 dollars", "foo [at] bar", "a @ b", "x (.) y", "v1.2.3 dot release", "plus one",
    ):
        assert private_data.all_spans(text) == []


def test_no_hidden_spans_in_the_documents(spark):
    assert all(s[3] for _, text in texts_of(spark, "/root/testdata/sf0.01") for s in private_data.all_spans(text))


def test_plain_spans_stay_and_are_not_cut():
    text = "jоhn.smith@example.com one 4845168114407329"  # a Cyrillic o: the pattern sees only the name's end
    assert private_data.all_spans(text) == [("email", 0, 22, False), ("email", 2, 22, True), ("card", 27, 43, True)]
    assert private_data.masked(text) == "<email> one <card>"


@pytest.mark.parametrize("part", ["a", "1", "1.", "+1", "@a.", "a@", "one ", " at ", "a at b.c ", "((", " ", "1-", "_-", "[  ", "a at b point c "])
def test_long_texts_take_linear_time(part):
    start = time.process_time()
    private_data.all_spans(part * (200_000 // len(part)) + "dot")
    assert time.process_time() - start < 20


def test_found_spans_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x a@b.co"), (3, "a@b.co"), (3, "a@b.co"), (4, "é😀 1.2.3.4")]
    found = private_data.digests(private_data.find(frame(spark, rows)))
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in found.collect()), key=str)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    row = lambda i, e, p, s: (i, e, p, 0, 0, digest(s), s)
    assert got == sorted([row(1, 0, 0, ""), row(2, 0, 0, ""), row(None, 1, 0, "email:2:8"), *[row(3, 1, 0, "email:0:6")] * 2,
                          row(4, 0, 1, "ip:3:10")], key=str)
    assert private_data.find(frame(spark, [])).collect() == []
    masked = private_data.redact(frame(spark, rows))
    assert masked.columns == frame(spark, []).columns
    assert sorted((r.doc_id, r.text, r.word) for r in masked.where("doc_id > 2").collect()) == [
        (3, "<email>", "w"), (3, "<email>", "w"), (4, "é😀 <ip>", "w")]


# Importance resampling ------------------------------------------------------------------

def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def grams_of(text):
    w = words_of(text)
    return [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, percent=5, min_words=20, buckets=10_000, seed=42):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, x in docs for g in grams_of(x))
    t = Counter(bucket(g) for x in target for g in grams_of(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows, entitled = [], []
    for doc, text in docs:
        grams = grams_of(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in grams)
        rows.append([doc, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words_of(text)) >= min_words:
            entitled.append(rows[-1])
    entitled.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k in range(percent * len(entitled) // 100):
        entitled[k][4] = k + 1
    return sorted(map(tuple, rows), key=str)


def resampled(spark, docs, target, **settings):
    spec = "item_id long, text string, bucket int"
    found = importance.resample(frame(spark, docs), spark.createDataFrame([(1, t, 2) for t in target], spec), **settings)
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=str)


ODD_TEXTS = [
    (1, None), (2, ""), (3, " .,;"), (4, "One"), (5, "one two"), (6, "é ü\0x 😀 ½a_b"), (7, "w x y z " * 5000), (8, "x" * 70_000 + " y " + "é" * 300),
    (None, "a b c d e " * 5), (9, "a b c d e " * 5), (9, "a b c d e " * 5), *((k, f"a b c k{k} " * 6) for k in range(10, 60)),
]


@pytest.mark.parametrize("target", [["a b c", None, "", "One two"], []])
def test_resampling_of_odd_texts(spark, target):
    assert resampled(spark, ODD_TEXTS, target, percent=50) == brute_resample(ODD_TEXTS, target, 50)
    assert resampled(spark, [], target) == []


def test_resampling_of_the_documents(spark):
    docs = texts_of(spark)
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert resampled(spark, docs, target) == brute_resample(docs, target)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_blocks_of_joined_texts_change_nothing(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK", block)
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "B", "é", " ", "-", "9", "\0", "c" * 150], k=rng.choice([0, 1, 5, 200]))) for _ in range(40)] + [None, "", "x" * 5000 + " y z"]
    got = Counter()
    for _, grams in importance.ngrams([None if t is None else t.encode() for t in texts]):
        for doc, crc in grams:
            got.update(zip(doc.tolist(), crc.tolist()))
    assert got == Counter((k, zlib.crc32(g.encode())) for k, t in enumerate(texts) for g in grams_of(t))


def test_ranks_follow_scores_with_many_ties(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("score"))
    got = [(r.doc_id, r["rank"]) for r in importance.ranked(rows, 40).where("rank IS NOT NULL").orderBy("rank").collect()]
    assert got == [(d, k + 1) for k, d in enumerate(sorted(range(4000), key=lambda d: (-(d % 3), d))[:1600])]
