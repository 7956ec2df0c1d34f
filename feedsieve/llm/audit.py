"""Interaction of filters: what each removes in every order, by contractions of contingency tensors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.llm.common import WORD

FILTERS = "ABCDE"
MIN_WORDS = 200  # A
MIN_DISTINCT = 50  # B: per cent of the words
MAX_CAPITALS = 2  # C: per cent of the code points
SYMBOLS = r"[#$%&*|]"  # D

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
PARTS = 64  # tensors contracted together
NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_COUNTS = ("n", "good", "toxic")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, same, failed) of every row of `docs` (doc_id, text, source).

    Bit k of `failed` says that the row's text fails filter k (A to D); `same` is the text's SHA-256.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    counted = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).select(
        "doc_id", "part", F.sha2("text", 256).alias("same"), F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("capitals"), F.length("text").alias("points"), F.col("text").rlike(SYMBOLS).alias("symbols"))
    tests = (F.col("n") < MIN_WORDS, 100 * F.col("distinct").cast("bigint") < MIN_DISTINCT * F.col("n").cast("bigint"),
             100 * F.col("capitals").cast("bigint") > MAX_CAPITALS * F.col("points").cast("bigint"), F.col("symbols"))
    bits = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return counted.select("doc_id", "part", F.unhex("same").alias("same"), bits.alias("failed"))


def cells(rows: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): counts by part and failure pattern, from (doc_id, part, same, failed, good, toxic).

    E (bit 4) holds for the rows of a text but those with its smallest doc_id. Copies of a text are never brought
    together: they are counted by doc_id, then by part and labels, and only these counts meet, one row for each part and
    pair of labels that the text occurs with.
    """
    kinds = ("part", "same", "failed", "good", "toxic")
    by_id = rows.groupBy(*kinds, "doc_id").agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    counts = by_id.groupBy(*kinds).agg(F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("without_id"),
                                       F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("same"))
    firsts = F.coalesce(F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")), F.lit(0))
    split = counts.withColumn("least", least).withColumn("firsts", firsts).select("part", "good", "toxic", F.explode(F.array(
        F.struct("failed", (F.col("firsts") + F.col("without_id")).alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("firsts")).alias("n")))).alias("cell"))
    n = F.col("cell.n")
    return split.where(n > 0).groupBy("part", F.col("cell.failed").alias("failed")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def steps(filters: str = FILTERS) -> list[tuple[str, int, str]]:
    """(order, step, filter) of every order of the filters."""
    return [("".join(order), k + 1, order[k]) for order in permutations(filters) for k in range(len(order))]


def selections(filters: str = FILTERS) -> dict[str, np.ndarray]:
    """For each count of a step: pass, fail or all along each filter's axis. Arrays of (steps, filters, 2)."""
    out = {"kept": [], "removed": [], "failing": [], "alone": []}
    for order, step, this in steps(filters):
        before = order[: step - 1]
        out["kept"].append([PASS if f in before or f == this else ALL for f in filters])
        out["removed"].append([FAIL if f == this else PASS if f in before else ALL for f in filters])
        out["failing"].append([FAIL if f == this else ALL for f in filters])
        out["alone"].append([FAIL if f == this else PASS for f in filters])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums of (parts, 2, 2, ...) tensors under every step's selection: (parts, steps)."""
    axes = range(1, tensor.ndim)
    operands = [x for k in axes for x in (chosen[:, k - 1], [tensor.ndim, k])]
    return np.einsum(tensor, [0, *axes], *operands, [0, tensor.ndim], optimize=True)


def interactions(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """NUMBERS for every part and step, from counts by failure pattern: arrays of (parts, 2 ** filters)."""
    # Bit 0 of a pattern is the first filter: reshaped, it is the last axis.
    n, good, toxic = (x.reshape(len(x), *[2] * len(filters)).transpose(0, *range(len(filters), 0, -1)) for x in (n, good, toxic))
    chosen = selections(filters)
    out = {"kept": contract(n, chosen["kept"]), "removed": contract(n, chosen["removed"])}
    out["redundant"] = contract(n, chosen["failing"]) - out["removed"]
    out["unique_fails"] = contract(n, chosen["alone"])
    out["good_lost"], out["toxic_lost"] = (contract(x, chosen["removed"]) for x in (good, toxic))
    letter = np.array([filters.index(f) for _, _, f in steps(filters)])
    total = np.stack([out["removed"][:, letter == k].sum(axis=1) for k in range(len(filters))], axis=1)
    out["shapley"] = total[:, letter]
    return out


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every = steps()
    orders, numbers = [o for o, _, _ in every], [s for _, s, _ in every]
    for batch in batches:
        for a in range(0, batch.num_rows, PARTS):
            rows = batch.slice(a, PARTS).to_pylist()
            counts = {k: np.zeros((len(rows), 1 << len(FILTERS)), np.int64) for k in _COUNTS}
            for i, row in enumerate(rows):
                for cell in row["cells"]:
                    for k in _COUNTS:
                        counts[k][i, cell["failed"]] = cell[k]
            found = interactions(*(counts[k] for k in _COUNTS))
            parts = pa.array([row["part"] for row in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), len(every))))
            yield pa.RecordBatch.from_arrays(
                [parts, pa.array(orders * len(rows)), pa.array(numbers * len(rows), pa.int32()), *[pa.array(found[k].reshape(-1)) for k in NUMBERS]],
                ["part", "filter_order", "step", *NUMBERS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters removes from each part of `docs` (doc_id, text, source), in every order of the filters.

    Returns one row per part, filter_order (all 120) and step (1 to 5), with the counts NUMBERS; see `interactions`. `labels`
    has doc_id, quality and toxic; a document is good or toxic if any of its labels says so.

    Rows travel without their texts and are reduced to counts per part and failure pattern, at most 32 per part; a part's
    counts are a 2x2x2x2x2 tensor, which one contraction per count turns into its 600 rows. Nothing reaches the driver.

    Null text: empty (fails A, passes B, C and D). Null source: part ''. Null doc_id: no smaller or larger than any other, so it
    never fails E, and has no labels. Rows that share a doc_id and a text pass E alike. Repeated rows count each. Empty
    input: empty result.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    rows = measured(docs).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    parts = cells(rows).groupBy("part").agg(F.collect_list(F.struct("failed", *_COUNTS)).alias("cells"))
    return parts.mapInArrow(_expand, "part string, filter_order string, step int, " + ", ".join(f"{k} bigint" for k in NUMBERS))
