"""Near-copies by Jaccard similarity of word n-grams, with vertical partitioning.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments; a
text's set falls into one part for each fragment.

* Candidates. Sets of similarity t differ in at most (1-t)/(1+t) * (|a|+|b|) n-grams. Cut
  into more fragments than that, two similar sets have a fragment in which they are equal.
  The number of fragments follows from a class of sizes; a set is cut for its own class and
  for the next one, so similar sets always share a cutting. Empty parts are left out where
  enough others remain, else they count as parts.
* Rarest parts. Of f parts that are not empty at most d can differ, so two similar sets share
  f-d of them. Any order of the parts allows each set to leave out its last f-d-1: some part
  is still shared. The order is by the number of sets that hold a part, so what many texts
  quote names no candidates (``rarest_stars``); a third of the parts can be left out.
* Sketches. A set's 512 parities, each of the number of its n-grams at one place, bound the
  difference of two sets from below; pairs beyond what may differ go before their n-grams are
  read (``plausible``).
* Verification. The partial overlap of each pair is counted fragment by fragment and summed
  per pair. Inside a fragment an n-gram is its hash's lower 32 bits, the fragment being given
  by the upper ones; two sets of 400 n-grams are miscounted by one in about 1 of 100,000.
  Pairs of larger sets whose count is near the threshold are counted again by whole hashes.
* What stars leave out. Where members of a group end in different components, all of them
  are first compared with the group's least member (a slice's star has another centre). Then
  they are compared through their differences from it: only pairs whose differences have
  enough in common can be similar (``prefixes``), and these are verified.
* Number of links. All links of a set lie in its component. There each set is taken as its
  difference from the n-grams that most sets of the component hold: pairs whose differences
  are small enough together are linked and are counted from a histogram, whatever their
  number; the others must share a part of their differences and are verified (``link_counts``).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftgrid.llm.common import (
    U64, batch_of, components, fresh, mix, release, row_key, schema, slices, stored, utf8, word_hashes,
)

#: A slice and what is sorted of it are in memory at once, in every Python worker.
SLICE = 1 << 20
#: kind 0: a row's set (node, n, set hash); kind 1: a part (key, hub); kind 2: (key, hub, other),
#: both with their cutting as n; kind 3: (spare parts, node, size) of a cutting n.
PARTS = schema("kind int, key bigint, a bigint, b bigint, n bigint")
#: A set's sketch is in its first row only.
SKETCH = [f"s{k}" for k in range(8)]
FRAGMENTS, WHOLE = (
    schema(f"node bigint, fragment int, n bigint, grams array<{kind}>, " + ", ".join(f"{s} bigint" for s in SKETCH))
    for kind in ("int", "bigint"))
#: Fragments in which overlaps are counted.
VERIFY_FRAGMENTS = 4
#: Sets with more n-grams are counted again by whole hashes where a miscount could decide.
LARGE = 400
#: Nodes that may be broadcast as a filter (16 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 1_000_000


def sets_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted by (row, hash), and their rows."""
    flat, at = utf8(texts)
    word, row = word_hashes(flat, at)
    counts = np.bincount(row, minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
    short = (counts > 0) & (counts < n)
    grams, rows = [], []
    m = len(word) - n + 1
    if m > 0:
        inside = row[:m] == row[n - 1:]
        h = np.zeros(m, U64)
        for k in range(n):
            h = mix(h * U64(0x9DDFEA08EB382D69) + word[k:k + m])
        grams.append(h[inside])
        rows.append(row[:m][inside])
    if short.any():  # the whole sequence is one n-gram
        first = (np.cumsum(counts) - counts)[short]
        size = counts[short]
        h = size.astype(U64)
        for k in range(n - 1):
            more = size > k
            h = np.where(more, mix(h * U64(0x9DDFEA08EB382D69) + word[np.minimum(first + k, len(word) - 1)]), h)
        grams.append(h)
        rows.append(np.flatnonzero(short))
    if not grams:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    gram, row = np.concatenate(grams), np.concatenate(rows)
    rank = np.lexsort((gram, row))
    gram, row = gram[rank], row[rank]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[new], row[new]


@lru_cache(None)
def cuttings(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each class, the fragments of its cutting, and the parts that may differ."""
    t = Fraction(percent, 100)
    first, fragments, differ = [1], [], []
    while True:
        top = int(first[-1] / t)  # the next class begins above
        d = int((1 - t) / (1 + t) * 2 * top)
        spare = 0 if d == 0 else max(1 if d < 8 else 2, d // 2)
        differ.append(d)
        fragments.append(d + 1 + spare)
        if first[-1] > largest:
            return np.array(first), np.array(fragments), np.array(differ)
        first.append(top + 1)


def parts_of(gram, row, sizes, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(row, key, cutting) of the parts of each set, and of both cuttings of all sets (cutting,
    how many parts are to spare)."""
    if not len(gram):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, U64), none, []
    first, fragments, differ = cuttings(percent, 1 << int(sizes.max()).bit_length())
    own = np.searchsorted(first, sizes, side="right") - 1
    value = mix(gram ^ U64(0x5851F42D4C957F2D))
    rows, keys, cuts, spares = [], [], [], []
    for step in (0, 1):
        cutting = np.maximum(own, 0) + step
        count = fragments[cutting]
        place = ((gram >> U64(32)) * count[row].astype(U64)) >> U64(32)
        new = np.ones(len(gram), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
        start = np.flatnonzero(new)
        total = np.add.reduceat(value, start)
        r, p = row[start], place[start]
        # the texts whose equal parts might all be empty ones
        full = np.bincount(r, minlength=len(sizes))
        spares.append((cutting, np.maximum(full - differ[cutting] - 1, 0)))
        scarce = np.flatnonzero((sizes > 0) & (full <= differ[cutting]) & (full < count))
        if len(scarce):
            every = np.repeat(scarce, count[scarce])
            at = np.concatenate([np.arange(c) for c in count[scarce]]).astype(U64)
            wide = U64(1 << 40)
            empty = ~np.isin(every.astype(U64) * wide + at, r.astype(U64) * wide + p)
            r, p = np.concatenate([r, every[empty]]), np.concatenate([p, at[empty]])
            total = np.concatenate([total, np.zeros(int(empty.sum()), U64)])
        rows.append(r)
        cuts.append(cutting[r])
        keys.append(mix(total + mix(cutting[r].astype(U64) * U64(1 << 32) + p)))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(cuts), spares


def _parts(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                node = batch.column("node").to_numpy()
                gram, row = sets_of(batch.column("text"), n)
                sizes = np.bincount(row, minlength=len(node)) if len(row) else np.zeros(len(node), np.int64)
                total = np.zeros((2, len(node)), U64)
                for k, salt in enumerate((0x2545F4914F6CDD1D, 0x1B873593CC9E2D51)):
                    np.add.at(total[k], row, mix(gram ^ U64(salt)))
                yield batch_of(PARTS, np.zeros(len(node), np.int32), total[0], node, total[1], sizes)
                r, key, cut, spares = parts_of(gram, row, sizes, percent)
                some = sizes > 0
                for cutting, spare in spares:
                    yield batch_of(PARTS, np.full(int(some.sum()), 3, np.int32), spare[some], node[some], sizes[some], cutting[some])
                own = node[r]
                rank = np.lexsort((own, key))
                key, own, cut = key[rank], own[rank], cut[rank]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
                key, own, cut = key[new], own[new], cut[new]
                head = np.ones(len(key), bool)
                head[1:] = key[1:] != key[:-1]
                hub = own[np.flatnonzero(head)][np.cumsum(head) - 1] if len(key) else own
                kind = np.where(head, 1, 2).astype(np.int32)
                yield batch_of(PARTS, kind, key, hub, pa.array(own, pa.int64(), mask=head), cut)
    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (kind, key, a): parts become pairs with the key's least hub."""
    last_key, last_hub = None, None
    for batch in batches:
        kind, key, a = (batch.column(c).to_numpy() for c in ("kind", "key", "a"))
        part = np.flatnonzero(kind == 1)
        rest = batch.filter(pa.array(kind != 1))
        if rest.num_rows:
            yield rest
        if not len(part):
            continue
        key, a, cut = key[part], a[part], batch.column("n").to_numpy(zero_copy_only=False)[part]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        hub = a[np.flatnonzero(head)][np.cumsum(head) - 1]
        if last_key is not None and key[0] == last_key:
            going_on = key == last_key
            hub[going_on] = last_hub
            head[0] = False
        last_key, last_hub = key[-1], hub[-1]
        m = np.flatnonzero(~head & (hub != a))
        if len(m):
            yield batch_of(PARTS, np.full(len(m), 2, np.int32), key[m], hub[m], a[m], cut[m])


def _fragments(n: int, count: int, whole_hash: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                node = batch.column("node").to_numpy()
                gram, row = sets_of(batch.column("text"), n)
                sizes = np.bincount(row, minlength=len(node))
                place = (gram >> U64(32)) * U64(count) >> U64(32)
                new = np.ones(len(gram), bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
                start = np.flatnonzero(new)
                value = gram.view(np.int64) if whole_hash else gram.astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(gram)).astype(np.int32)), pa.array(value))
                columns = [node[row[start]], place[start].astype(np.int32), sizes[row[start]], lists]
                head = np.ones(len(start), bool)
                head[1:] = row[start][1:] != row[start][:-1]
                for values in sketches(gram, row, len(node)).T:
                    columns.append(pa.array(values[row[start]].view(np.int64), pa.int64(), mask=~head))
                yield batch_of(WHOLE if whole_hash else FRAGMENTS, *columns)
    return run


def sketches(gram: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Parities of the n-grams of each row at 64 places of each word of ``SKETCH``."""
    place = (mix(gram ^ U64(0x2127599BF4325C37)) & U64(64 * len(SKETCH) - 1)).astype(np.int64)
    odd = np.bincount(row * (64 * len(SKETCH)) + place, minlength=n_rows * 64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64).reshape(n_rows, len(SKETCH))


def plausible(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches differ in no more places than similar sets may differ in."""
    of = lambda c: parts.where("s0 is not null").select(
        F.col("node").alias(c), F.col("n").alias(f"n{c}"), *(F.col(s).alias(f"{s}{c}") for s in SKETCH))
    apart = sum((F.bit_count(F.col(f"{s}a").bitwiseXOR(F.col(f"{s}b"))) for s in SKETCH), F.lit(0))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(
        apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    return stored(near.select("a", "b"), "plausible")


def sizes_allow(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def fragments(pairs: DataFrame, texts: DataFrame, n: int, whole_hash: bool = False) -> DataFrame:
    """(node, fragment, n, grams) of the nodes in pairs (a, b)."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "involved")
    small = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    own = texts.join(F.broadcast(nodes) if small else nodes, "node", "leftsemi").dropDuplicates(["node"])
    return stored(own.mapInArrow(
        _fragments(n, VERIFY_FRAGMENTS, whole_hash), WHOLE if whole_hash else FRAGMENTS), "fragments")


def by_fragment(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """A row (a, b, fragment, na, nb, ga, gb) per pair and fragment; sets without it are null."""
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    cut = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(VERIFY_FRAGMENTS - 1))).alias("fragment"))
    return cut.join(right, ["b", "fragment"], "left").join(left, ["a", "fragment"], "left")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, na, nb, common) of pairs (a, b) of nodes: partial overlaps summed per pair."""
    partial = by_fragment(pairs, parts).select(
        "a", "b", "na", "nb", F.coalesce(F.when(
            F.col("ga").isNotNull() & F.col("gb").isNotNull(),
            F.size(F.array_intersect("ga", "gb")).cast("long")), F.lit(0)).alias("common"))
    return partial.groupBy("a", "b").agg(
        F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("common").alias("common"))


def miscount(a: str, b: str) -> Column:
    """What the overlap of sets of these sizes may be off by; 0 for sets that are not large."""
    size = F.greatest(a, b).cast("double")
    return F.when(size > LARGE, 4 + 6 * size * size / (VERIFY_FRAGMENTS * 2.0**32)).otherwise(0.0)


def verified(pairs: DataFrame, parts: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar; ``parts`` holds the fragments of their nodes."""
    beyond = F.col("common") * 100 - (F.col("na") + F.col("nb") - F.col("common")) * percent
    unsure = (F.greatest("na", "nb") > LARGE) & (F.abs(beyond) <= (100 + percent) * miscount("na", "nb"))
    told = stored(overlaps(pairs, parts).select("a", "b", unsure.alias("unsure"), (beyond >= 0).alias("link"))
                  .where("unsure or link"), "links")
    links, near = told.where("not unsure").select("a", "b"), told.where("unsure").select("a", "b")
    if near.isEmpty():
        return links
    again = overlaps(near, fragments(near, texts, n, whole_hash=True)).where(beyond >= 0)
    return links.unionByName(stored(again.select("a", "b"), "links"))


def near_copies(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``grouped_copies`` without its node and component columns; see there."""
    return grouped_copies(docs, n, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def representatives(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of near copies stays.

    It is the one with the least doc_id (null last). Texts without words are linked with
    nothing, so they stay. All columns are kept as they are.
    """
    node = fresh(docs, "node")
    rows = grouped_copies(docs, n, percent, count=False).where("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    chosen = rows.groupBy("component").agg(F.min(first).alias("first")).select(F.col("first.node").alias(node))
    has_words = F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    kept = docs.where(has_words).withColumn(node, F.xxhash64(*row_key(docs))).join(chosen, node, "leftsemi")
    return kept.dropDuplicates([node]).drop(node).unionByName(docs.where(~has_words))


def grouped_copies(docs: DataFrame, n: int = 3, percent: int = 90, count: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links,
    and node and component, the hashes that name the row and its group. Without ``count``
    there is no n_links.

    Words are lower-cased in A-Z; a text of fewer than ``n`` words is one n-gram, one without
    words has no n-gram and links with nothing. Texts link when
    100 * |intersection| >= percent * |union|. component_id is the least doc_id that links
    reach. n_links is the number of other sets that the text's set links with; texts of equal
    sets are one. Repeated rows link with each other; null ids take part, and a component of null
    ids only has a null component_id. An empty table gives an empty table.
    """
    doc, txt = row_key(docs)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.xxhash64(doc, txt).alias("node"))
    # parts meet by their key; other rows only have to be spread
    place = F.when(F.col("kind") == 1, F.col("key")).when(F.col("kind") == 2, F.col("b")).otherwise(F.col("a"))
    table = stored(
        texts.select("node", "text").mapInArrow(_parts(n, percent), PARTS)
        .repartition(place).sortWithinPartitions("kind", "key", "a").mapInArrow(_stars, PARTS), "stars")
    release(docs.sparkSession)
    sets = table.where("kind = 0").select(
        F.col("a").alias("node"), "n", F.col("key").alias("s1"), F.col("b").alias("s2"))
    # nodes with equal sets have one representative; no words, no links
    leaders = sets.groupBy("n", "s1", "s2").agg(F.min("node").alias("leader"))
    leader = stored(sets.where("n > 0").distinct().join(leaders, ["n", "s1", "s2"]).select("node", "leader", "n"), "leaders")
    of = lambda c: leader.select(F.col("node").alias(c), F.col("leader").alias(f"{c}_"))
    meeting = table.where("kind = 2").select("key", F.col("n").alias("cutting"), "a", "b").join(of("a"), "a").join(of("b"), "b").where(
        "a_ <> b_").select("key", "cutting", F.explode(F.array("a_", "b_")).alias("node")).distinct()
    spare = table.where("kind = 3").select(
        F.col("a").alias("node"), F.col("n").alias("cutting"), F.col("b").alias("n"), F.col("key").alias("spare")).distinct()
    stars = rarest_stars(stored(meeting, "set-parts"), spare)
    first = stored(stars.where(sizes_allow("na", "nb", percent)).select("a", "b").distinct(), "pairs")
    plain = texts.select("node", "text")
    parts = fragments(first, plain, n)
    links = verified(plausible(first, parts, percent), parts, plain, n, percent)
    release(docs.sparkSession)
    found = stored(components(links), "components")
    around = left_out(stars, found)
    if not around.isEmpty():
        parts = fragments(around, plain, n)
        apart, differences = prefixes(around, parts, percent)
        for pairs, rows in ((hub_pairs, apart), (some_pairs, differences), (all_pairs, differences)):
            more = stored(pairs(rows, found, percent), "left-out")
            if not more.isEmpty():
                links = links.unionByName(verified(plausible(more, parts, percent), parts, plain, n, percent))
                release(docs.sparkSession)
                found = stored(components(links), "components")
    joined = leader.join(found.select(F.col("node").alias("leader"), "component"), "leader", "left").select(
        "node", "leader", F.coalesce("component", "leader").alias("component"))
    rows = texts.select("doc_id", "node").join(sets.select("node", "n").distinct(), "node").join(joined, "node", "left")
    rows = rows.withColumn("component", F.coalesce("component", "node"))
    least = rows.where(F.col("n") > 0).groupBy("component").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "component", "left")
    counted = []
    if count:
        rows = rows.join(link_counts(found, plain, n, percent).withColumnRenamed("node", "leader"), "leader", "left")
        counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        *counted, "node", "component")


def link_counts(found: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, n_links): with how many other sets of its component (node, component) a set links.

    Let x have d n-grams in its difference from a set h, and w = d * (100 + percent) - |x| *
    (100 - percent). Sets x and y whose differences have o n-grams in common link when
    wx + wy <= 2 * o * (100 + percent). Those with wx + wy <= 0 are counted by their w; the
    others need o >= max(1, d - |x| * (100 - percent) / percent), for x as for y, so they
    share one of the rarest n-grams of their differences. h are the n-grams that more than
    half of the component's sets hold. Hashes have 64 bits here.
    """
    parts = fragments(found.select(F.col("node").alias("a"), F.col("component").alias("b")), texts, n, whole_hash=True)
    held = found.join(parts.select("node", "fragment", "grams"), "node").select("component", "fragment", F.explode("grams").alias("gram"))
    total = found.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    most = held.groupBy("component", "fragment", "gram").agg(F.count(F.lit(1)).alias("n_sets")).join(total, "component").where(
        "2 * n_sets > m").groupBy("component", "fragment").agg(F.collect_list("gram").alias("most"))
    empty = F.array().cast("array<bigint>")
    one, two = F.coalesce("grams", empty), F.coalesce("most", empty)
    cut = found.select("node", "component", F.explode(F.sequence(F.lit(0), F.lit(VERIFY_FRAGMENTS - 1))).alias("fragment"))
    differ = stored(
        cut.join(parts.select("node", "fragment", "n", "grams"), ["node", "fragment"], "left").join(most, ["component", "fragment"], "left")
        .select("component", "node", "n", F.concat(F.array_except(one, two), F.array_except(two, one)).alias("differ")), "differ")
    w = F.col("d") * (100 + percent) - F.col("n") * (100 - percent)
    sizes = stored(differ.groupBy("component", "node").agg(F.max("n").alias("n"), F.sum(F.size("differ")).alias("d"))
                   .withColumn("w", w), "sizes")
    # how many sets of a component have at most a given w, at every w that is asked for
    steps = sizes.select("component", "w", F.lit(1).alias("k")).unionByName(
        sizes.select("component", (-F.col("w")).alias("w"), F.lit(0).alias("k"))).groupBy("component", "w").agg(F.sum("k").alias("k"))
    upto = steps.select("component", (-F.col("w")).alias("w"), F.sum("k").over(Window.partitionBy("component").orderBy("w")).alias("near"))
    near = sizes.join(upto, ["component", "w"]).select("node", (F.col("near") - F.when(F.col("w") <= 0, 1).otherwise(0)).alias("k"))
    grams = differ.select("component", "node", F.explode("differ").alias("gram"))
    shared = grams.groupBy("component", "gram").agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1")
    largest = sizes.groupBy("component").agg(F.max("w").alias("top"))
    some = sizes.join(largest, "component").where("w + top > 0").drop("top")
    each = Window.partitionBy("node")
    prefix = grams.join(shared, ["component", "gram"]).join(some, ["component", "node"]).withColumn(
        "place", F.row_number().over(each.orderBy("n_sets", "gram")) + F.col("d") - F.count(F.lit(1)).over(each))
    least = F.greatest(F.lit(1), F.col("d") - F.floor(F.col("n") * (100 - percent) / percent + 1e-9))
    prefix = stored(prefix.where(F.col("place") <= F.col("d") - least + 1).select("component", "gram", "node", "n", "d", "w"), "rarest")
    left, right = (prefix.select("component", "gram", *(F.col(v).alias(v + k) for v in ("node", "n", "d", "w"))) for k in "ab")
    beyond = F.col("wa") + F.col("wb")
    pairs = left.join(right, ["component", "gram"]).where(
        (F.col("nodea") < F.col("nodeb")) & (beyond > 0) & (beyond <= 2 * (100 + percent) * F.least("da", "db"))
        & sizes_allow("na", "nb", percent)).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"))
    links = overlaps(plausible(pairs.distinct(), parts, percent), parts).where(
        F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent)
    others = links.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).alias("k"))
    return stored(near.unionByName(others).groupBy("node").agg(F.sum("k").cast("long").alias("n_links")), "link-counts")


def rarest_stars(parts: DataFrame, spare: DataFrame) -> DataFrame:
    """(key, a, b, na, nb): the least set a of those that keep a part, with each other one.

    ``parts`` (key, cutting, node) are shared by two sets or more; of a set's parts in a
    cutting the ``spare`` ones (node, cutting, n, spare) that most sets hold are left out.
    """
    held = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n_sets"))
    each = Window.partitionBy("node", "cutting").orderBy(F.desc("n_sets"), F.desc("key"))
    kept = stored(
        parts.join(held, "key").join(spare, ["node", "cutting"]).withColumn("place", F.row_number().over(each))
        .where("place > spare").select("key", "node", "n"), "rarest-parts")
    hubs = kept.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1")
    return stored(kept.join(hubs, "key").where("node <> hub.node").select(
        "key", F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")), "set-stars")


def left_out(stars: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): the least member and another one of groups that ended in several components."""
    comp = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    split = stars.join(comp("a"), "a", "left").join(comp("b"), "b", "left").where(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("key").distinct()
    members = stored(stars.join(split, "key", "leftsemi").select("key", F.explode(F.array("a", "b")).alias("b")).distinct(), "members")
    hubs = members.groupBy("key").agg(F.min("b").alias("a"))
    return stored(members.join(hubs, "key").where("a <> b").select("a", "b").distinct(), "around")


def prefixes(around: DataFrame, parts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(hub, x, nh, n, d), the size d of the difference of x from hub, and (hub, gram, x, n, d,
    u), its rarest n-grams.

    Let h be the group's least member and dx the n-grams in which x and h differ. Sets x and
    y differ in dx and dy without what these have in common. If x is not linked to h, then
    |dx| + |dy| is more than similar sets may differ in, whatever y is. So a link needs
    |dx & dy| >= (|dx| + |dy| - c * (|x| + |y|)) / 2 > 0 with c = (1-t)/(1+t): this is a
    set join of the differences, with a prefix filter from the rarest n-gram on. N-grams
    that no other difference holds never count as common. A set that is linked to h can only
    be linked to sets that are not, so it needs more than (|dy| + c * (|h| - |y|)) / 2. This
    holds once every x similar to h is in its component, which ``hub_pairs`` sees to.
    """
    empty = F.array().cast("array<int>")
    one, two = F.coalesce("ga", empty), F.coalesce("gb", empty)
    differ = by_fragment(around, parts).select(
        F.col("a").alias("hub"), F.col("b").alias("x"), "na", "nb",
        F.concat(F.array_except(one, two), F.array_except(two, one)).alias("differ"))
    sizes = stored(differ.groupBy("hub", "x").agg(
        F.max("na").alias("nh"), F.max("nb").alias("n"), F.sum(F.size("differ")).alias("d")), "distances")
    grams = stored(differ.select("hub", "x", F.explode("differ").alias("gram")), "differences")
    shared = grams.groupBy("hub", "gram").agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1")
    common = grams.join(shared, ["hub", "gram"]).join(sizes, ["hub", "x"])
    t = percent / 100
    c = (1 - t) / (1 + t)
    each = Window.partitionBy("hub", "x")
    common = common.withColumn("u", F.count(F.lit(1)).over(each)).withColumn(
        "place", F.row_number().over(each.orderBy("n_sets", "gram")) + F.col("d") - F.col("u"))
    linked = F.col("d") <= c * (F.col("n") + F.col("nh")) + 1e-9
    least = F.when(linked, F.floor((F.col("d") + c * (F.col("nh") - F.col("n"))) / 2 - 1e-9) + 1).otherwise(
        F.ceil(F.col("d") - c * (1 + 1 / t) * F.col("n") - 1e-9))
    least = F.greatest(F.lit(1), least - F.ceil(miscount("nh", "n")))
    common = common.where((F.col("place") <= F.col("d") - least + 1) & (F.col("u") >= least))
    return sizes, stored(common.select("hub", "gram", "x", "n", "d", "u"), "prefixes")


def _in_components(prefix: DataFrame, found: DataFrame) -> DataFrame:
    """Prefixes with their components, where an n-gram meets more than one."""
    of = found.select(F.col("node").alias("x"), F.col("component").alias("c"))
    prefix = prefix.join(of, "x", "left").withColumn("c", F.coalesce("c", "x"))
    mixed = prefix.groupBy("hub", "gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    return prefix.join(mixed.select("hub", "gram"), ["hub", "gram"], "leftsemi")


def _may_link(one: str, two: str, percent: int) -> Column:
    """Whether two sets in different components can be similar by their counts."""
    c = (1 - percent / 100) / (1 + percent / 100)
    of = lambda v: (F.col(f"{v}{one}"), F.col(f"{v}{two}"))
    need = (sum(of("d")) - c * sum(of("n"))) / 2 - 1e-9 - miscount(f"n{one}", f"n{two}")
    return (of("x")[0] != of("x")[1]) & (of("c")[0] != of("c")[1]) & sizes_allow(f"n{one}", f"n{two}", percent) & (
        F.least(*of("u")) >= need)


def _sorted_pairs(rows: DataFrame, one: str, two: str) -> DataFrame:
    return rows.select(F.least(f"x{one}", f"x{two}").alias("a"), F.greatest(f"x{one}", f"x{two}").alias("b"))


def hub_pairs(apart: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Every set that its difference shows to be similar to the hub, but is in another component."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    common = (F.col("nh") + F.col("n") - F.col("d")) / 2 + miscount("nh", "n")
    near = apart.where(common * (100 + percent) >= (F.col("nh") + F.col("n")) * percent - 1e-6)
    near = near.join(of("hub"), "hub", "left").join(of("x"), "x", "left").where(
        F.coalesce("chub", "hub") != F.coalesce("cx", "x"))
    return near.select(F.least("hub", "x").alias("a"), F.greatest("hub", "x").alias("b")).distinct()


def some_pairs(prefix: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """For each shared n-gram every set with the smallest one and with its neighbour.

    They join most of what belongs together, so few pairs are left between components.
    """
    order = Window.partitionBy("hub", "gram").orderBy("d", "x")
    names = ("x", "n", "d", "u", "c")
    rows = _in_components(prefix, found).select(
        "hub", "gram", *(F.col(v).alias(f"{v}1") for v in names),
        F.first(F.struct(*names)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("two"),
        F.lag(F.struct(*names)).over(order).alias("three"))
    rows = rows.select("*", *(F.col(f"two.{v}").alias(f"{v}2") for v in names), *(F.col(f"three.{v}").alias(f"{v}3") for v in names))
    return _sorted_pairs(rows.where(_may_link("1", "2", percent)), "1", "2").unionByName(
        _sorted_pairs(rows.where(_may_link("1", "3", percent)), "1", "3")).distinct()


def all_pairs(prefix: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Every pair between components that shares an n-gram of its prefixes and may be similar."""
    prefix = _in_components(prefix, found)
    left, right = (prefix.select("hub", "gram", *(F.col(v).alias(f"{v}{k}") for v in ("x", "n", "d", "u", "c"))) for k in "12")
    pairs = left.join(right, ["hub", "gram"]).where((F.col("x1") < F.col("x2")) & _may_link("1", "2", percent))
    return _sorted_pairs(pairs, "1", "2").distinct()
