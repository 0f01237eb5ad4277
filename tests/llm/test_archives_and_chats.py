"""Web archives, chat formatting, registration and the pipeline."""

import hashlib
import importlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from liftgrid.llm import chat, common, queries, warc

SMALL = "/root/testdata/sf0.001"
PAGES = [
    (1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://é", ""), (5, "u", "é😀"),
    (6, "v", "WARC/1.1\r\n\r\n" * 50), (7, "w", "long " * 200_000), (None, "n", "<p>x</p>"), (8, "%0A", "<p>y</p>"), (8, "%0A", "<p>y</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, "r", "d") for i, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, row string, digest string").repartition(3)


def captures(spark, df, min_bytes=0):
    folder = common.scratch_path(spark, "warc-test")
    records = warc.read_records(warc.write_archives(df, folder, min_bytes), folder)
    return records, warc.with_targets(warc.assemble(records)).collect()


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_captures_come_back(spark, pages, min_bytes):
    records, rows = captures(spark, pages, min_bytes)
    bodies = {(i, u, (h or "").encode()) for i, u, h in PAGES}  # equal rows are one capture
    first = {}
    for i, _, body in bodies:
        if len(body) >= min_bytes and i is not None:
            first[body] = min(first.get(body, i), i)
    want = Counter()
    for i, u, body in bodies:
        response = first.get(body, i) == i
        want[i, u, len(body), warc.digest_of(body), "response" if response else "revisit", None if response else first[body]] += 1
    got = Counter((r.page_id, r.target_uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    assert got == want
    for r in rows:
        assert r.request.block.startswith(b"GET ") and r.metadata.block.startswith(b"fetchedBytes")
        payload = bytes(r.response.block).partition(b"\r\n\r\n")[2]
        assert warc.digest_of(payload) == r.payload_digest if r.record_type == "response" else payload == b""
    assert records.filter("concurrent_to IS NOT NULL").count() == 2 * records.filter("record_type IN ('response', 'revisit')").count()


def test_no_pages_no_files(spark, pages):
    assert captures(spark, pages.limit(0))[1] == []


def test_metadata_without_a_response_is_no_capture(spark, pages):
    folder = common.scratch_path(spark, "warc-test")
    records = warc.read_records(warc.write_archives(pages, folder), folder).filter("record_type <> 'response' OR page_id <> 1")
    assert 1 not in {r.page_id for r in warc.assemble(records).collect()}


# Chats ----------------------------------------------------------------------------------

TEXTS = st.text(alphabet=st.sampled_from(list("<|>\\im_startendé😀\n ")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=8))
def test_formatting_can_be_undone(turns):
    roles, texts = (e(pa.array([t[k] for t in turns], pa.string())) for k, e in enumerate((chat.escape_role, chat.escape)))
    column, before, inside, size = chat.assemble(roles, texts)
    whole = "".join(column.to_pylist())
    assert chat.conversation(whole) == turns
    at = 0
    for (_, text), b, n, total in zip(turns, before, inside, size):
        assert chat.unescape(whole[at + b:at + b + n]) == text
        at += total
    assert at == len(whole)


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in groups.items():
        turns = [(r, t) for *_, r, t in sorted(own)]
        said = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_turns(df)).collect()}


def test_chats_of_odd_turns(spark):
    rows = [
        (1, 1, "assistant", "<|im_end|>"), (1, 0, "user", None), (1, 2, None, "x"), (1, None, "assistant", "first"),
        (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 0, "user", "no id"), (3, 5, "a<|b", "<\\|\n"), (4, 0, "us\ner", "hi"), (4, 1, "assis\\ntant\\", "\n"),
        (4, 0, "assistant", "y" * 3_000_000), *((5, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(3000)),
    ]
    df = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, position string")
    assert digests(df) == brute(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # conversations run over batches
    try:
        assert digests(df) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert digests(df.limit(0)) == {}


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    want = brute([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op7_chat_formatting(spark, SMALL).collect()}
    assert got == want


# Registration and pipeline --------------------------------------------------------------

def test_ten_operators_and_the_pipeline_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_pipeline_stages_decide(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()
    planted = [(90_001, first.text), (90_002, f"{first.text[:200]} {item.text} {first.text[200:400]}"), (90_003, None)]
    extra = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in planted], docs.schema)
    docs, counts = docs.unionByName(extra), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, SMALL), name)
        assert docs.columns == before.columns
        counts.append((before.count(), docs.count()))
    ids = {r.doc_id for r in docs.collect()}
    assert 90_001 not in ids and 90_002 not in ids and 90_003 in ids and len(ids) > 100
    assert all(a >= b for a, b in counts)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == len(ids) and out.filter("not same").count() == 0
