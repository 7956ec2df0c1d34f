"""Deduplication, top-k, priorities and ordinals that stay parallel when one group is huge.

Top-k and first-per-key use `row_number() <= k`: Spark turns that into a WindowGroupLimit, so every
map task keeps at most k rows per key before the shuffle. Quantile cut-offs come from a histogram of
the one-decimal score (at most 1,001 values), never from sorting a whole week in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.policy import Policy

# Rows of one score that may share a window task; positions are unique, so a block never exceeds it.
ORDINAL_BLOCK = 1 << 20


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "_rank") -> DataFrame:
    """At most k rows per key by an order; keeps the rank column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1).drop("_rank")


def dedup_episode_id(items: DataFrame) -> DataFrame:
    """First item per (feed, episode id) in feed order."""
    return first_per_key(items, ["podcast_id", "episode_id"], [F.col("item_pos")])


def dedup_cross_feed(items: DataFrame) -> DataFrame:
    """First item per title+date (joined without a separator) over all feeds; a missing title or date counts as ''."""
    keyed = items.withColumn("_key", F.concat(F.coalesce("episode_title", F.lit("")), F.coalesce("publish_date", F.lit(""))))
    return first_per_key(keyed, ["_key"], [F.col("feed_ord"), F.col("item_pos")]).drop("_key")


def last_record_wins(records: DataFrame, key: str, seq: list[str]) -> DataFrame:
    return first_per_key(records, [key], [F.col(c).desc() for c in seq])


def decision_history(records: DataFrame, keep: int = 52) -> DataFrame:
    """Last `keep` decisions per episode, oldest first. Needs episode_id, seq, decision."""
    recent = top_per_key(records.select("episode_id", "seq", "decision"), ["episode_id"], [F.col("seq").desc()], keep)
    ordered = F.sort_array(F.collect_list(F.struct("seq", "decision")))
    return recent.groupBy("episode_id").agg(ordered["decision"].alias("statuses"))


def fixed_priority(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def priority_cutoffs(items: DataFrame, group: str = "week_id") -> DataFrame:
    """Per group: number of previews and the scores at the 20 % and 60 % positions, from a histogram."""
    hist = items.filter(F.col("decision") == "preview").groupBy(group, "final_score").agg(F.count("*").alias("c"))
    best_first = Window.partitionBy(group).orderBy(F.col("final_score").desc())
    ranked = hist.withColumn("upto", F.sum("c").over(best_first)).withColumn(
        "n", F.sum("c").over(Window.partitionBy(group)))

    def place(share: float) -> Column:
        return F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(share)) - 1)

    return ranked.groupBy(group).agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("upto") > place(0.2), F.col("final_score"))).alias("upper"),
        F.max(F.when(F.col("upto") > place(0.6), F.col("final_score"))).alias("lower"),
    )


def relative_priority(items: DataFrame, group: str = "week_id") -> DataFrame:
    """Adds `priority`: previews by their place within the group, all others medium."""
    # One row per week: bounded by the calendar, so the broadcast cannot grow with the items.
    joined = items.join(F.broadcast(priority_cutoffs(items, group)), group, "left")
    score, upper, lower = F.col("final_score"), F.col("upper"), F.col("lower")
    bar = F.when(F.col("n") >= 5, upper).otherwise((upper + lower) / 2)
    placed = F.when(score >= bar, "high").when(score >= lower, "medium").otherwise("low")
    priority = F.when((F.col("decision") == "preview") & (F.col("n") >= 2), placed).otherwise("medium")
    return joined.withColumn("priority", priority).drop("n", "upper", "lower")


def weekly_limits(items: DataFrame, policy: Policy, group: str = "week_id") -> DataFrame:
    """Score mode only: full items beyond the limit become previews, previews beyond theirs are skipped.

    Demoted full items do not use up preview places. Needs decision, final_score, feed_ord, item_pos, reason.
    """
    keys = [group, "decision", "feed_ord", "item_pos"]
    limit = F.when(F.col("decision") == "full", policy.weekly_full_limit).otherwise(policy.weekly_preview_limit)
    ranked = top_per_key(
        items.filter(F.col("decision").isin("full", "preview")).select(*keys, "final_score"), [group, "decision"],
        [F.col("final_score").desc(), F.col("feed_ord"), F.col("item_pos")],
        max(policy.weekly_full_limit, policy.weekly_preview_limit))
    within = ranked.filter(F.col("_rank") <= limit).select(*keys, F.lit(True).alias("_within"))
    # At most (full + preview limit) rows per week.
    joined = items.join(F.broadcast(within), keys, "left")
    over = F.col("_within").isNull()
    demoted_full, demoted_preview = over & (F.col("decision") == "full"), over & (F.col("decision") == "preview")
    return joined.withColumns({
        "reason": F.when(demoted_full, F.concat("reason", F.lit("（超出周限，降级为preview）")))
        .when(demoted_preview, F.concat("reason", F.lit("（超出周限，降级为skip）"))).otherwise(F.col("reason")),
        "decision": F.when(demoted_full, "preview").when(demoted_preview, "skip").otherwise(F.col("decision")),
    }).drop("_within")


def rank_by_score(items: DataFrame) -> DataFrame:
    """Best score first, earlier items first among equals, with the place from 1 on in `place`."""
    ranked = ordinal(items.withColumn("_worst", -F.col("final_score")), [], ["_worst", "feed_ord"], "item_pos", "place")
    return ranked.drop("_worst").orderBy("place")


def union_decisions(full: DataFrame, preview: DataFrame, skip: DataFrame) -> DataFrame:
    """Items of the three decisions as one table with a `decision` column."""
    parts = [df.withColumn("decision", F.lit(name)) for name, df in (("full", full), ("preview", preview), ("skip", skip))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Items of several feeds in the order of the feeds (`feed_ord`); a column that a feed lacks is null there."""
    out = None
    for i, feed in enumerate(feeds):
        part = feed.withColumn("feed_ord", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def ordinal(df: DataFrame, group: list[str], sort: list[str], pos: str, name: str = "ordinal",
            weight: Column | None = None, block: int = ORDINAL_BLOCK) -> DataFrame:
    """1-based running position within a group, ordered by few-valued `sort` columns and then unique `pos`.

    With `weight` the result is the start position of a row that takes up `weight` places. Counts per
    (group, sort, block of pos) are summed first; only rows of one block meet in a window task.
    """
    w = weight if weight is not None else F.lit(1)
    keyed = df.withColumns({"_block": F.floor(F.col(pos) / block), "_w": w.cast("bigint")})
    bucket = [*group, *sort, "_block"]
    sizes = keyed.groupBy(*bucket).agg(F.sum("_w").alias("_size"))
    before = Window.partitionBy(*group).orderBy(*sort, "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inner = Window.partitionBy(*bucket).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inner", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    return placed.join(starts, bucket).withColumn(name, F.col("_start") + F.col("_inner") + 1).drop(
        "_block", "_w", "_start", "_inner")


def top_recommendations(items: DataFrame, group: str = "week_id", k: int = 3) -> DataFrame:
    """Best k of full and preview per group."""
    wanted = items.filter(F.col("decision").isin("full", "preview"))
    return top_per_key(wanted, [group], [F.col("final_score").desc(), F.col("decision"), F.col("feed_ord"), F.col("item_pos")], k, "place")
