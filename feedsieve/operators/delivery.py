"""Selection queue and the idempotent delivery and notification states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.functions.items import selection_id
from feedsieve.operators.joins import selection_in_window

REQUIRED_RUN_FIELDS = ("run_id", "week_id", "window_start", "window_end")


def enqueue_selections(selections: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Queue rows of one or many selections; with `runs`, only those inside the window of the run they name."""
    rows = selections if runs is None else selection_in_window(selections, runs)
    stamp = F.date_format(F.from_utc_timestamp("selected_ts", "Asia/Shanghai"), "yyyyMMddHHmmss")
    local = F.date_format(F.from_utc_timestamp("selected_ts", "Asia/Shanghai"), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(
        selection_id(F.col("episode_id"), F.col("action"), stamp).alias("selection_id"),
        F.coalesce("run_id", F.lit("manual")).alias("run_id"), F.coalesce("week_id", F.lit("manual")).alias("week_id"), "episode_id",
        F.coalesce("podcast_id", F.lit("")).alias("podcast_id"), "action", F.concat(local, F.lit("+0800")).alias("selected_at"),
        F.lit("queued").alias("status"))


def queued_items(queue: DataFrame, selection: str | None = None) -> DataFrame:
    rows = queue.filter(F.col("status") == "queued")
    return rows if selection is None else rows.filter(F.col("selection_id") == selection)


def missing_fields(columns=REQUIRED_RUN_FIELDS) -> Column:
    """Names of the required run fields that are absent or empty."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", c) for c in columns]))


def required_fields(runs: DataFrame) -> DataFrame:
    return runs.withColumn("missing", missing_fields()).withColumn("is_valid", F.size("missing") == 0)


def delivered(status: Column, doc_id: Column, doc_url: Column) -> Column:
    return F.coalesce(status, F.lit("")).eqNullSafe(F.lit("success")) & (F.coalesce(doc_id, F.lit("")) != "") & (F.coalesce(doc_url, F.lit("")) != "")


def delivery_action(done: Column, has_meta: Column, force: Column) -> Column:
    return (
        F.when(done & ~force, "skip").when(done, "force-create").when(has_meta & ~force, "requires-force").otherwise("create"))


def notify_action(done: Column, delivery_done: Column, has_meta: Column, force: Column) -> Column:
    return (
        F.when(done & ~force, "skip").when(done, "force-send").when(~delivery_done, "requires-delivery")
        .when(has_meta & ~force, "requires-force").otherwise("send"))


def processing_log_rows(processed: DataFrame) -> DataFrame:
    """Audit rows of processed selections."""
    error = F.coalesce("error", F.lit(""))
    return processed.select(
        F.col("finished_at").alias("timestamp"), "selection_id", "episode_id", "action",
        F.when(error == "", "success").otherwise("error").alias("status"), "started_at", "finished_at",
        F.coalesce("doc_url", F.lit("")).alias("doc_url"), F.coalesce("doc_id", F.lit("")).alias("doc_id"), error.alias("error"))


def delivery_log_rows(deliveries: DataFrame, event: str) -> DataFrame:
    return deliveries.select(F.col("delivered_at").alias("timestamp"), F.lit(event).alias("event"), "run_id", "week_id", "status",
                             F.coalesce("doc_url", F.lit("")).alias("doc_url"), F.coalesce("doc_id", F.lit("")).alias("doc_id"))
