"""Mixing sources to target weights by weighted fair queueing (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.llm.common import WORD
from feedsieve.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
CELLS = 4096  # parts of a source's shuffled order, and of the merged queue, whose sums are carried over


def words_in(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _shuffle_key(seed: int):
    """A fixed pseudo-random 60-bit number for each document."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Weights go to the sources in code point order, null last, and repeat. The budget is `share` of all sizes. No
    target exceeds `max_epochs` times its source's size; the excess is shared again by weight. The table has one row
    per source, so its windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    most = (F.col("source_size") * max_epochs).cast("double")
    ranked = sizes.withColumn("weight", w).withColumn("most", most).withColumn("level", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # A source is full when filling all to its level fits into the budget; from the first that is not, the rest is shared by weight.
    filled = ranked.withColumns({
        "full_before": F.coalesce(F.sum("most").over(earlier), F.lit(0.0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)),
        "budget": F.sum("source_size").over(everything) * F.lit(share)})
    at = filled.withColumn("is_full", F.col("full_before") + F.col("level") * F.col("weight_left") <= F.col("budget"))
    level = F.max(F.when(~F.col("is_full"), (F.col("budget") - F.col("full_before")) / F.col("weight_left"))).over(everything)
    return at.withColumn("open_level", level).select(
        "source", "source_size", "weight", F.when(F.col("is_full"), F.col("most")).otherwise(F.col("open_level") * F.col("weight")).alias("target"))


def _running(df: DataFrame, group: list, cell: str, order: list, value: str, name: str) -> DataFrame:
    """Running sum of `value`: sums of cells are carried over, so a task sorts one cell of a group only."""
    sums = df.groupBy(*group, cell).agg(F.sum(value).alias("cell_sum"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(sums.withColumn("carried", F.coalesce(F.sum("cell_sum").over(before), F.lit(0))), "mix-cells")
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, cell]]
    joined = df.alias("l").join(carried.alias("r"), keys).select("l.*", F.col("r.carried"))
    inside = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn(name, F.col("carried") + F.sum(value).over(inside)).drop("carried")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: int = 17) -> DataFrame:
    """What a mix takes of each document of `docs` (doc_id, source, size).

    Every source's documents are shuffled by a fixed hash and queued up to `max_epochs` times. A queued copy's virtual
    finish time is the source's words up to its end divided by the source's weight. All copies are put in one
    order of finish times (cells of that order stand for ranges), and the queue is cut where its words exceed the
    budget. Returns doc_id, source, size, source_size, target, copies and taken (copies times size), one row per
    input row; rows that repeat each count.

    Null source: a source of its own, last in order. Size 0: nothing taken. Null doc_id: shuffled as an empty id.
    Equal shuffle keys fall back on doc_id, size and copy; rows that agree in all stay interchangeable. Empty input:
    empty result.
    """
    # Rows that agree in everything are counted together, so that copies of one row cannot be told apart or lost.
    rows = docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")).withColumn("key", _shuffle_key(seed))
    rows = materialize(rows, "mix-rows")
    aims = materialize(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size")), weights, max_epochs, share), "mix-targets")
    queued = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumn("cell", (F.col("key") / F.lit((1 << 60) // CELLS)).cast("int")).drop("times")
    placed = _running(queued, ["source"], "cell", ["key", "doc_id", "size", "copy"], "size", "upto").drop("cell")
    placed = placed.alias("l").join(aims.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select(
        "l.doc_id", "l.source", "l.size", "l.key", "l.copy", "l.upto", "r.source_size", "r.weight", "r.target").where("size > 0")
    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("weight"))
    # Nothing is taken that ends after twice the latest target: the cut lies before it.
    totals = aims.agg(F.max(F.col("target") / F.col("weight")).alias("last"), F.sum("source_size").alias("all")).first()
    last, budget = float(totals["last"] or 0.0), float(totals["all"] or 0) * share
    queue = copies.withColumn("cell", F.least(F.floor(F.col("finish") / F.lit((last or 1.0) / CELLS)), F.lit(2 * CELLS)).cast("int")).where(F.col("cell") < 2 * CELLS)
    queue = _running(queue, [], "cell", ["finish", "key", "doc_id", "source", "size", "copy", "epoch"], "size", "queued")
    got = queue.where(F.col("queued") <= F.lit(budget)).groupBy("doc_id", "source", "size", "copy").agg(F.count("*").alias("copies"))
    base = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "source", "size", "copy")]
    full = base.alias("l").join(got.alias("r"), same, "left").select("l.doc_id", "l.source", "l.size", F.coalesce("r.copies", F.lit(0)).cast("bigint").alias("copies"))
    return full.alias("l").join(aims.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select(
        "l.doc_id", "l.source", "l.size", "r.source_size", "r.target", "l.copies", (F.col("copies") * F.col("l.size")).alias("taken"))
