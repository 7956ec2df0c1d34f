"""Near-duplicate vectors by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsieve.llm.common import components
from feedsieve.session import materialize

THRESHOLD = 0.95
GROUP_ROWS = 8192  # vectors of one side of a tile, about
ROWS, COLUMNS = 512, 2048  # part of a tile whose products are held at once

_TILE = pa.schema([("class", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers from -127 to 127, scale, and exact length of the rounding error of each unit vector."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None])
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the sets of i and j; a set's label is its smallest member."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors of x and y (of x alone, each pair once, if y is None) with cosine >= threshold.

    With x = s q + e the exact product differs from (s q)(s' q') by at most |e| + (1 + |e|)|e'|, so a pair whose int8
    product stays further below the threshold cannot link; only the others are computed in double precision. Products
    of the whole numbers are exact: in single precision while 127 * 127 * length < 2**24.
    """
    alone, y = y is None, x if y is None else y
    kind = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64
    (qx, sx, ex), (qy, sy, ey) = quantise(x), quantise(y)
    qx, qy, sy32 = qx.astype(kind), qy.astype(kind), sy.astype(kind)
    for c in range(0, len(y), COLUMNS):
        worst = ey[c : c + COLUMNS].max()
        least = ((threshold - ex - (1 + ex) * worst - 1e-5) / sx).astype(kind)  # 1e-5: more than all rounding in `kind`
        for r in range(0, min(len(x), c + COLUMNS) if alone else len(x), ROWS):
            product = qx[r : r + ROWS] @ qy[c : c + COLUMNS].T
            product *= sy32[c : c + COLUMNS]
            i, j = np.nonzero(product >= least[r : r + ROWS, None])
            i, j = i + r, j + c
            if alone:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                near = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
                if near.any():
                    yield a[near], b[near]


def _tile(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        ids, weight, side = table["rep"].to_numpy(), table["weight"].to_numpy(), table["part"].to_numpy()
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = flat.reshape(len(ids), -1)
        x = x / np.abs(x).max(axis=1)[:, None]  # no overflow in the length
        x /= np.linalg.norm(x, axis=1)[:, None]
        first, last = key[1].as_py(), key[2].as_py()
        left = np.flatnonzero(side == first)
        right = None if first == last else np.flatnonzero(side == last)
        label, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        if len(left) and (right is None or len(right)):
            for i, j in links(x[left], None if right is None else x[right], threshold):
                i, j = left[i], (left if right is None else right)[j]
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                label = _unite(label, i, j)
        some = np.flatnonzero(count)
        return pa.Table.from_arrays([pa.array(table["class"].to_numpy()[some]), pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(count[some])], schema=_TILE)
    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links between vectors of `vectors` (vec_id, embedding) with a cosine of `threshold` or more, and their components.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included) and
    kept (vec_id = component_id), one row per input row.

    Equal vectors become one class with a weight. Classes are dealt by hash into groups of about `group_rows`; each pair
    of groups is one tile, and each vector goes to the tiles of its group. A tile returns, per vector, its number of links
    and one edge of a spanning forest, never the pairs. Groups are even whatever the copies, so is the work; it
    grows with the square of the number of classes, as the exact answer by tile products does.

    Null, zero or non-finite vectors and rows without vec_id link with nothing (component: own id). Vectors of different
    lengths do not link. Rows that repeat count as vectors of their own, with one id. Empty input: empty result.
    """
    rows = vectors.select("vec_id", "embedding")
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = rows.where(F.coalesce(sound, F.lit(False)))
    classes = materialize(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("class", F.xxhash64("embedding")), "vector-classes")
    # Links are counted by class; in the graph, unequal vectors of one id (repeated ids) are one node.
    groups = max(1, -(-classes.count() // group_rows))
    dealt = classes.withColumn("length", F.size("embedding")).withColumn("part", F.pmod("class", F.lit(groups)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other")
    found = materialize(dealt.groupBy("length", "low", "high").applyInArrow(_tile(threshold), "class bigint, a bigint, b bigint, n bigint"), "vector-tiles")
    counts = materialize(found.groupBy("class").agg(F.sum("n").alias("near")), "vector-counts")
    placed = materialize(components(found.select("a", "b")).toDF("rep", "component"), "vector-components")
    ends = classes.join(counts, "class", "left").join(placed, "rep", "left").select(
        "embedding", F.coalesce("near", F.lit(0)).alias("near"), "weight", F.coalesce("component", "rep").alias("component"))
    ends = materialize(ends, "vector-ends")
    return rows.join(ends, (rows["embedding"] == ends["embedding"]) & rows["vec_id"].isNotNull(), "left").select(
        "vec_id", F.coalesce(F.col("near") + F.col("weight") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"), F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"))
