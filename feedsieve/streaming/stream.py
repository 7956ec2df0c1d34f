"""The weekly semantics on unbounded input."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsieve.functions.when import WEEK_OFFSET, week_id
from feedsieve.session import materialize, new_folder
from feedsieve.sources import runs

REGISTRY = "episode_id string, first_seen timestamp, last_seen timestamp, seen_count bigint, decision string, last_seq bigint"
BACKLOG_BATCHES = 24


def read_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def files_per_batch(spark: SparkSession, path: str, schema, least: int) -> int:
    """Files that a batch takes, `least` or more, so that what has landed at `path` is drained in at most BACKLOG_BATCHES batches.

    A batch costs its jobs and a commit, however few rows it holds: with a fixed number of files the batches, and that cost, would
    grow with the backlog.
    """
    landed = len(spark.read.schema(schema).parquet(path).inputFiles())
    return max(least, math.ceil(landed / BACKLOG_BATCHES))


def week_counts(stream: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Counts per business week and key; with a watermark a week is final once it has passed by the delay."""
    weeks = F.window(ts, "7 days", "7 days", WEEK_OFFSET)
    grouped = stream.withWatermark(ts, delay).groupBy(weeks.alias("week"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(week_id(F.col("week.start")).alias("week_id"), F.col("week.start").alias("week_start"), *keys, "n")


def first_seen(stream: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """First item per key; the state of a key is dropped once the watermark has passed it by the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def drain_to_table(stream: DataFrame, label: str) -> str:
    """Process everything available, exactly once, into a fresh table; returns its path."""
    spark = stream.sparkSession
    path = new_folder(spark, label)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-checkpoint")
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return path


def merge_registry(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Registry after a batch of (episode_id, ts, seq, decision): counts add up, the latest decision stays.

    The batch is reduced per key before it meets the state, so a key repeated without end stays one row.
    """
    fresh = batch.groupBy("episode_id").agg(
        F.min("ts").alias("n_first"), F.max("ts").alias("n_last"), F.count("*").alias("n_count"), F.max_by("decision", "seq").alias("n_decision"), F.max("seq").alias("n_seq"))
    both = old.join(fresh, "episode_id", "full")
    newer = F.coalesce(F.col("n_seq") > F.col("last_seq"), F.col("n_seq").isNotNull())
    return both.select(
        "episode_id", F.least("first_seen", "n_first").alias("first_seen"), F.greatest("last_seen", "n_last").alias("last_seen"),
        (F.coalesce("seen_count", F.lit(0)) + F.coalesce("n_count", F.lit(0))).alias("seen_count"),
        F.when(newer, F.col("n_decision")).otherwise(F.col("decision")).alias("decision"), F.greatest("last_seq", "n_seq").alias("last_seq"))


def reduce_batch(batch: DataFrame) -> DataFrame:
    """A batch of (episode_id, ts, seq, decision) as registry rows, one per key."""
    return batch.groupBy("episode_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("seen_count"),
        F.max_by("decision", "seq").alias("decision"), F.max("seq").alias("last_seq"))


def combine(segments: DataFrame) -> DataFrame:
    """Registry rows of any number of segments (REGISTRY and segment) as one row per key; of equal places the earlier segment's stays."""
    return segments.groupBy("episode_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"),
        F.max_by("decision", F.struct("last_seq", -F.col("segment"))).alias("decision"), F.max("last_seq").alias("last_seq"))


def _read_segments(spark: SparkSession, root: str, segments: list[dict]) -> DataFrame:
    """Rows of the named (bucket, version) segments, each with its version as `segment`."""
    if not segments:
        return spark.createDataFrame([], f"{REGISTRY}, segment bigint")
    paths = [f"{root}/data/{s['folder']}/bucket={s['bucket']}" for s in segments]
    version = F.regexp_extract(F.input_file_name(), r"/v=(\d+)-", 1).cast("bigint")
    return spark.read.schema(REGISTRY).parquet(*paths).withColumn("segment", version)


def registry_segments(spark: SparkSession, root: str, version: int | None = None) -> list[dict]:
    """(bucket, folder, rows) of the state's segments, from the manifest of a version (the latest)."""
    version = runs.current_version(spark, root) if version is None else version
    return runs.version_facts(spark, root, version)["segments"] if version else []


def read_registry(spark: SparkSession, root: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The registry of a version (the latest), whole or only some buckets of it."""
    segments = registry_segments(spark, root, version)
    return combine(_read_segments(spark, root, [s for s in segments if buckets is None or s["bucket"] in buckets]))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def apply_batch(batch: DataFrame, root: str, batch_id: int, buckets: int = 16) -> None:
    """Turn version `batch_id` of the registry at `root` into the next by a batch of (episode_id, ts, seq, decision).

    The state is hashed into buckets; a bucket is a short list of segments, each with one row per key. A batch touches only the
    buckets of its keys and writes one segment for each: its own rows, merged with those last segments that are not more than
    twice as large. So a bucket has few segments, and a row is written again only about once for each doubling of what came
    after it: what a batch writes follows the batch, not the state. The manifest (buckets x segments, a bounded list) is
    committed with the version, whole and once; a batch that runs again finds its version and changes nothing.
    """
    spark = batch.sparkSession
    if (runs.current_version(spark, root) or 0) > batch_id:
        return
    segments = registry_segments(spark, root, batch_id)
    fresh = materialize(reduce_batch(batch).withColumn("bucket", bucket_of(F.col("episode_id"), buckets)), "registry-batch")
    sizes = {r["bucket"]: r["n"] for r in fresh.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    kept, merged = [s for s in segments if s["bucket"] not in sizes], []
    for bucket, n in sizes.items():
        own = [s for s in segments if s["bucket"] == bucket]
        while own and own[-1]["rows"] <= 2 * n:
            n += own[-1]["rows"]
            merged.append(own.pop())
        kept += own
    folder = f"v={batch_id + 1:08d}-{uuid.uuid4().hex}"
    rows = fresh.drop("bucket").withColumn("segment", F.lit(batch_id + 1).cast("bigint")).unionByName(_read_segments(spark, root, merged))
    path = f"{root}/data/{folder}"
    combine(rows).withColumn("bucket", bucket_of(F.col("episode_id"), buckets)).write.partitionBy("bucket").parquet(path)
    if sizes:
        written = spark.read.schema(f"{REGISTRY}, bucket int").parquet(path).groupBy("bucket").agg(F.count("*").alias("n")).collect()
        kept += [{"bucket": r["bucket"], "folder": folder, "rows": r["n"]} for r in written]
    try:
        runs.commit_version(spark, root, batch_id + 1, segments=kept)
    except runs.VersionConflict:  # the same batch, run twice at once
        pass


def stream_registry(stream: DataFrame, root: str, buckets: int = 16) -> None:
    """Keep a registry up to date from a stream; see `apply_batch` for its state and `read_registry` for reading it.

    Batch b always turns version b into version b + 1, so a batch that runs again after a failure counts nothing twice. Late items
    are like any others: counts add up, and the decision with the highest seq stays whenever it comes.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, root, batch_id, buckets))
    writer.option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def first_by_order(stream: DataFrame, ts: str, keys: list[str], order: list[str], delay: str, span: str = "1 day") -> DataFrame:
    """Of the items with equal keys in one span of time, that which comes first by `order`, whatever came first to the stream.

    The state holds the best item of every open key and span; it is emitted once, when the watermark has passed the span, so
    a better item may arrive until then. With a span of a day this is `dedup_cross_feed` on a stream: its key holds the date.
    """
    rows = stream.withWatermark(ts, delay)
    columns = [c for c in stream.columns if c != ts]
    best = F.min_by(F.struct(ts, *columns), F.struct(*order))
    grouped = rows.groupBy(F.window(ts, span).alias("span"), *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(best.alias("best"))
    return grouped.select("best.*")
