"""Quality rules in DataFrame functions: text statistics and a log-likelihood ratio.

Words and pairs of neighbouring words are hashed into ``buckets``. Two multinomials over the
buckets are counted: the raw corpus (every text) and the trusted target (texts labelled 1).
A text's score is the mean of log(p_target / p_raw) over its n-grams, so length does not
move it; a text is kept if it passes the base rules and its score reaches ``threshold``.

All of it runs in the JVM. Counting combines on the map side, so at most ``buckets`` rows
leave each task; the table of ratios has ``buckets`` numbers and travels as a literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: lambdas would evaluate it per element."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def covered(positions: Column, width: int) -> Column:
    """Places in windows of ``width`` that begin at the ascending ``positions``."""
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
    step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(width), p - s["last"])).alias("n"))
    return F.aggregate(positions, start, step, lambda s: s["n"].cast("long"))


def repeated_words(hashes: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` words that occur twice or more, from the words' hashes."""

    def windows(h):
        places = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(places, lambda i: F.xxhash64(*(h[i + k] for k in range(width))))

    def positions(grams):
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        same = lambda s, k, j: F.when((j >= 0) & (j < F.size(s)), s[j]["g"] == s[k]["g"]).otherwise(False)
        twice = lambda s: F.filter(s, lambda x, k: same(s, k, k - 1) | same(s, k, k + 1))
        return F.array_sort(F.transform(let(pairs, twice), lambda x: x["i"]))

    def count(grams):
        # most texts repeat nothing: a hash set tells, and only the others are sorted
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
            covered(positions(grams), width))

    return F.when(F.size(hashes) < width, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), count))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text, label columns of ``docs`` with the base statistics and the words' hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    words = words_of(text)
    return docs.select(
        "doc_id",
        F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
    ).select(
        "doc_id", F.size("hashes").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("hashes")).alias("n_repeat_words"), "hashes",
    ).withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def hashed_ngrams(hashes: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = let(hashes, lambda x: F.transform(
        F.when(F.size(x) > 1, F.sequence(F.lit(0), F.size(x) - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.pmod(F.xxhash64(x[i], x[i + 1]), F.lit(buckets)).cast("int")))
    return F.concat(one, two)


def ratios(docs: DataFrame, labels: DataFrame, label: str, buckets: int, smoothing: float) -> list[float]:
    """log(p_target / p_raw) of every bucket, counted over all texts."""
    trusted = labels.where(F.col(label) == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    small = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    trusted = trusted.withColumn("trusted", F.lit(1))
    hashes = F.transform(words_of(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(trusted) if small else trusted, "doc_id", "left").select(
        hashes.alias("hashes"), F.coalesce("trusted", F.lit(0)).alias("trusted"))
    counted = texts.select("trusted", F.explode(hashed_ngrams(F.col("hashes"), buckets)).alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    raw, target = [0] * buckets, [0] * buckets
    for r in counted.collect():  # at most ``buckets`` rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * buckets
    low, high = sum(target) + smoothing * buckets, sum(raw) + smoothing * buckets
    return [math.log((t + smoothing) / low) - math.log((r + smoothing) / high) for t, r in zip(target, raw)]


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", buckets: int = 1 << 14,
          smoothing: float = 1.0, threshold: float = -0.075) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): base statistics, score, kept.

    Null texts have no words and fail the base; null ids keep their rows; repeated rows are
    judged alike. Without a trusted text all scores are 0, so the base decides. Other
    columns of ``docs`` are not read.
    """
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios(docs, labels, label, buckets, smoothing))), ",").cast("array<double>")
    rows = base_rules(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    mean = let(hashed_ngrams(F.col("hashes"), buckets), lambda x: F.when(F.size(x) > 0, F.aggregate(
        x, F.lit(0.0), lambda total, b: total + table[b]) / F.size(x)).otherwise(0.0))
    return rows.withColumn("score", F.round(mean, 9)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")
