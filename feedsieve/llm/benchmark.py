"""Benchmark decontamination by SimHash of item-sized windows (DataFrame operations only)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.llm.common import row_key
from feedsieve.session import materialize

SHINGLE = 5
SIMILARITY = 0.75
RADIUS = 19  # bits in which a window's and an item's fingerprint may differ
BLOCKS, BLOCK_BITS = 4, 16
BROADCAST_ANCHORS = 1_000_000  # shingles of items sent to all executors at most (24 bytes each); more are joined by a shuffle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = " \t\n\x0b\f\r"
# The fingerprint's bit b is set when most shingle hashes of w have it set.
_SIMHASH = "aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(if(2 * size(filter(w, h -> getbit(h, b) = 1)) > size(w), 1L, 0L), b))"
# Weighted Jaccard similarity of the bags w and v: a shingle's weight is the number of times it occurs.
_SHARED = "aggregate(array_distinct(v), 0, (acc, g) -> acc + least(size(filter(v, h -> h = g)), size(filter(w, h -> h = g))))"
# All starts, in order, of windows that cover `need` of the (sorted) places: from each place on that is the first of them,
# back to the place before it or as far as the window still reaches the last of them.
_STARTS = """flatten(transform(if(size(places) >= need, sequence(0, size(places) - need), cast(array() as array<int>)), i -> if(
    greatest(0, places[i + need - 1] - wide + 1, if(i > 0, places[i - 1] + 1, 0)) <= least(places[i], greatest(0, total - long)),
    sequence(greatest(0, places[i + need - 1] - wide + 1, if(i > 0, places[i - 1] + 1, 0)), least(places[i], greatest(0, total - long))), cast(array() as array<int>))))"""
# Whether some shingle of the window w has the same place in the item v, has it there or later, has it there or earlier.
_IN_PLACE = {
    "same": "exists(zip_with(v, w, (a, b) -> coalesce(a = b, false)), x -> x)",
    "later": "exists(sequence(1, size(v)), j -> array_position(w, element_at(v, j)) between 1 and j)",
    "earlier": "exists(sequence(1, size(w)), i -> array_position(v, element_at(w, i)) between 1 and i)",
}


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null has none."""
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WHITE))
    return F.filter(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(words: Column, size: int | Column) -> Column:
    """Hashes of all runs of `size` words, in order: each word is hashed once, a run's hash is that of its words' hashes.

    The words are bound to a lambda variable: named twice in plain expressions, they would be split again for each run.
    """
    def runs(w: Column) -> Column:
        n = F.size(w) - size + 1
        return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(w, i, size)))

    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), runs), 1)


def _flips(most: int) -> list[int]:
    """All block patterns with at most `most` bits set."""
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(BLOCK_BITS), n)]


def _blocks(df: DataFrame, flips: list[int]) -> DataFrame:
    """Each fingerprint's blocks, and all values that differ from them by one of the patterns."""
    block = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.shiftright("print", k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value")) for k in range(BLOCKS)]))
    parts = df.withColumn("part", block)
    return parts.withColumn("flip", F.explode(F.lit(flips).cast("array<bigint>"))).withColumn("value", F.col("part.value").bitwiseXOR(F.col("flip"))).withColumn("block", F.col("part.block")).drop("part", "flip")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """Passages of `docs` (doc_id, text) that are as similar as `similarity` to an item of `items` (item_id, text).

    Returns doc_id, row (key of the row's content), item_id, similarity, start (first word of the best window) and
    n_words (of the item), one row per document row content and item.

    A window has as many words as the item; words are lower-cased (A-Z). Windows are taken at every start where they can be
    similar: where they cover as many `size`-word shingles of items of that length, in whatever order, as the least similarity
    asks for. Equal windows are one, however many documents hold them. Among a document's equally similar windows, those come first
    in which some shingle has the place that it has in the item (at either end of the document: had it, if the document
    reached further), then the one that starts first. Windows and items get 64-bit SimHash fingerprints, cut into four blocks: fingerprints within
    `radius` bits agree in some block but for radius / 4 bits, so a join on block values, with the patterns of such
    differences split between both sides, finds all of them among items of the same length. Those are verified exactly by
    their weighted Jaccard similarity. The radius is about 2.7 standard deviations above the bits in which fingerprints
    with the least similarity differ on average.

    Items or documents that are null, empty or without words match nothing. Items with fewer than `size` words are one
    shingle of all their words. A document shorter than an item is one window. Null ids are passed on. Documents with the
    same content share a row key; repeated items each match. Empty input: empty result.
    """
    slots = radius // BLOCKS
    near_items, near_windows = _flips(slots - slots // 3), _flips(slots // 3)
    known = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    known = known.withColumn("n", F.size("words")).withColumn("v", shingles_of(F.col("words"), F.least("n", F.lit(size))))
    known = materialize(known.select("item_id", "n", "v", F.least("n", F.lit(size)).alias("size")).withColumn("item", F.xxhash64("n", "v")), "bench-items")
    classes = known.dropDuplicates(["item"])
    anchors = materialize(classes.select("n", "size", F.explode("v").alias("hash")).distinct(), "bench-anchors")
    small = anchors.count() <= BROADCAST_ANCHORS

    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    placed = None
    for r in anchors.select("size").distinct().orderBy("size").collect():  # at most `size` values; usually one
        own = anchors.where(F.col("size") == r["size"])
        runs = rows.select("row", shingles_of(words_of(F.col("text")), r["size"]).alias("hashes"))
        found = runs.select("row", F.size("hashes").alias("total"), F.posexplode("hashes").alias("place", "hash")).join(F.broadcast(own) if small else own, "hash")
        found = found.select("row", "total", "n", "size", "place")
        placed = found if placed is None else placed.unionByName(found)
    if placed is None:
        return docs.select("doc_id", row_key("doc_id", "text").alias("row")).limit(0).selectExpr("doc_id", "row", "CAST(NULL AS BIGINT) AS item_id", "0D AS similarity", "0 AS start", "0 AS n_words")
    groups = placed.groupBy("row", "total", "n", "size").agg(F.array_sort(F.collect_set("place")).alias("places"))
    groups = groups.withColumn("long", F.col("n") - F.col("size") + 1).withColumn("wide", F.least("long", "total"))
    groups = groups.withColumn("need", F.greatest(F.lit(1), F.ceil(similarity * (F.col("wide") + F.col("long")) / (1 + similarity) - 1e-9)).cast("int"))
    starts = materialize(groups.select("row", "n", "size", F.expr(_STARTS).alias("starts")).where(F.size("starts") > 0), "bench-starts")
    # The documents are read again, and only those that have such windows are split once more.
    placed = rows.join(starts, "row").select("doc_id", "row", "n", "size", "starts", shingles_of(words_of(F.col("text")), F.col("size")).alias("hashes"))
    placed = placed.select("doc_id", "row", "n", "size", "hashes", F.explode("starts").alias("start"))
    wide = F.col("n") - F.col("size") + 1
    windows = placed.select("doc_id", "row", "n", "start", (F.col("start") + wide >= F.size("hashes")).alias("ends"), F.slice("hashes", F.col("start") + 1, wide).alias("w"))
    windows = materialize(windows.withColumn("window", F.xxhash64("n", "w")), "bench-windows")
    contents = materialize(windows.select("window", "n", "w").dropDuplicates(["window"]).withColumn("print", F.expr(_SIMHASH)), "bench-contents")
    prints = materialize(classes.select("item", "n", F.col("v").alias("w")).withColumn("print", F.expr(_SIMHASH)).withColumnRenamed("w", "v"), "bench-prints")
    left = _blocks(contents.select("window", "n", "print"), near_windows)
    right = _blocks(prints.select("item", "n", F.col("print")), near_items).withColumnRenamed("print", "other")
    # Both sides grow by the patterns, which the planner's estimates do not see: never sent to all executors.
    pairs = left.join(right.hint("merge"), ["n", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= radius).select("window", "item").distinct()
    both = pairs.join(contents.select("window", "w"), "window").join(prints.select("item", "v"), "item").withColumn("shared", F.expr(_SHARED))
    both = both.withColumn("similarity", F.col("shared") / (F.size("v") + F.size("w") - F.col("shared"))).where(F.col("similarity") >= similarity)
    matches = materialize(both.select("window", "item", "similarity", *[F.expr(x).alias(name) for name, x in _IN_PLACE.items()]), "bench-matches")
    hits = windows.select("doc_id", "row", "window", "start", "ends", F.col("n").alias("n_words")).join(matches, "window")
    in_place = F.col("same") | (F.col("start") == 0) & F.col("later") | F.col("ends") & F.col("earlier")
    best = hits.groupBy("doc_id", "row", "item", "n_words").agg(F.max(F.struct("similarity", in_place.alias("in_place"), (-F.col("start")).alias("back"))).alias("b"))
    best = best.select("doc_id", "row", "item", "n_words", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).alias("start"))
    return best.join(known.select("item", "item_id"), "item").select("doc_id", "row", "item_id", "similarity", "start", "n_words")
