"""Queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.llm import (
    chat, decontamination, importance, language_model, ngram_join, oracles, private_data, quality_classifier, quality_rules,
    sentence_pieces, spelling, suffix_dedup, toxicity, warc,
)
from liftgrid.llm.common import read_table, scratch_path
from liftgrid.session import prepare

#: Folder of the public tokenizer files; an environment variable of the same name overrides it.
TOKENIZERS = os.environ.get("LIFTGRID_TOKENIZERS", "/opt/tokenizers")

#: Rows that reach Python at once; texts are long, and memory is bounded by their bytes.
ARROW_ROWS = "1000"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return read_table(spark, sf_dir, name)


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "warc")
    records = warc.read_records(warc.write_archives(pages, folder), folder, blocks=False)
    return warc.with_targets(warc.assemble(records)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri",
        F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return quality_rules.judge(docs, read_table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return suffix_dedup.remove_repeats(docs).drop("kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return decontamination.contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return language_model.score(docs, language_model.fit(docs))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return quality_classifier.classify(docs, read_table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    machine = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine)


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, decoded again: the ids, their number and score, and whether the text came back."""
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    docs = table(spark, sf_dir)
    coded = sentence_pieces.decode(sentence_pieces.encode(docs, model), model)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "score", "ids",
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir))


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digests(private_data.find(table(spark, sf_dir)))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    return importance.resample(docs, read_table(spark, sf_dir, "benchmark"))


def all_queries() -> dict[str, Query]:
    return {name: run for name, run in globals().items() if name.startswith("op") and callable(run)}


def all_oracles() -> dict[str, str]:
    return oracles.all_oracles()
