"""Stored runs, state tables and logs: written as new folders, never in place."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = ("full", "preview", "skip")


def write_run_result(decisions: DataFrame, path: str, expected: str | None = None) -> None:
    """Store decisions by week and run; a rerun replaces exactly its own partitions.

    `expected` names a column holding the week the run was started for; a row of another week fails the write.
    """
    rows = decisions
    if expected is not None:
        same = F.when(F.col("week_id") == F.col(expected), F.col("week_id")).otherwise(
            F.raise_error(F.concat(F.lit("week mismatch: "), F.col("week_id"), F.lit(" is not "), F.col(expected))))
        rows = rows.withColumn("week_id", same).drop(expected)
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_id", "run_id").parquet(path))


def read_runs(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def scan_run_result(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Rows of one run, or of the latest; the run column is a partition, so only its files are read."""
    if run_id is not None:
        return runs.filter(F.col("run_id") == run_id)
    newest = runs.agg(F.max("run_id").alias("run_id"))
    return runs.join(F.broadcast(newest), "run_id")  # a single row


def run_bucket_lookup(runs: DataFrame, episode_id: str) -> DataFrame:
    """One episode wherever it landed: full first, then preview, then skip."""
    place = F.when(F.col("decision") == "full", 0).when(F.col("decision") == "preview", 1).otherwise(2)
    return runs.filter(F.col("episode_id") == episode_id).withColumn("bucket_order", place)


def latest_run(results: DataFrame, reports: DataFrame) -> DataFrame:
    """Newest run whose data agrees with the folder it lies in and whose report comes from the same run."""
    agrees = (F.col("run_id") == F.col("dir_run_id")) & (F.col("week_id") == F.col("dir_week_id"))
    runs = results.groupBy("dir_week_id", "dir_run_id").agg(
        F.min("run_id").alias("run_id"), F.min("week_id").alias("week_id"), F.count_if(~agrees).alias("mismatches"))
    reported = reports.select(F.col("run_id").alias("dir_run_id"), F.col("week_id").alias("dir_week_id")).distinct()
    good = runs.filter(F.col("mismatches") == 0).join(reported, ["dir_week_id", "dir_run_id"], "left_semi")
    return good.agg(F.max(F.struct("run_id", "week_id")).alias("top")).select("top.run_id", "top.week_id")


def run_log_rows(decisions: DataFrame) -> DataFrame:
    """One summary row per run."""
    return decisions.groupBy("week_id", "run_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("decision") == b).alias(b) for b in BUCKETS])


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a log table."""
    rows.write.mode("append").parquet(path)


def write_cache_entries(entries: DataFrame, path: str) -> None:
    """Publish finished entries only."""
    entries.filter(F.col("status").isin("ok", "partial_ok")).write.mode("append").parquet(path)


def replace_rows(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write a table partitioned by `keys`; partitions that the rows name are replaced, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


class VersionConflict(Exception):
    """Another writer has committed the version first."""


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file whole, unless there is one; of several writers exactly one succeeds.

    Written under another name first. A local file gets its final name by a link, which fails where the name is taken; elsewhere
    the store's rename must refuse an existing target, as that of HDFS does.
    """
    fs, final = _store(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}"
    if fs.getScheme() == "file":
        end, start = final.toUri().getPath(), spark._jvm.org.apache.hadoop.fs.Path(draft).toUri().getPath()
        os.makedirs(os.path.dirname(end), exist_ok=True)
        with open(start, "w", encoding="utf-8") as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(start, end)
        except FileExistsError:
            return False
        finally:
            os.unlink(start)
        return True
    start = spark._jvm.org.apache.hadoop.fs.Path(draft)
    fs.mkdirs(final.getParent())
    out = fs.create(start, False)
    out.write(bytearray(content.encode()))
    out.close()
    done = not fs.exists(final) and fs.rename(start, final)
    if not done:
        fs.delete(start, False)
    return bool(done)


def _commits(spark: SparkSession, root: str) -> list[int]:
    """Committed versions, newest first."""
    fs, folder = _store(spark, f"{root}/_commits")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def _commit(spark: SparkSession, root: str, version: int) -> dict:
    fs, path = _store(spark, f"{root}/_commits/{version:08d}")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_version(spark: SparkSession, root: str, version: int, **facts) -> None:
    """Make a version of the state at `root` valid, with facts about it; VersionConflict if it already is."""
    if not _create_once(spark, f"{root}/_commits/{version:08d}", json.dumps(facts)):
        raise VersionConflict(f"{root}: version {version} is committed already")


def write_version(rows: DataFrame, root: str, version: int, token: str = "") -> str:
    """Write a state table as a new version and commit it; readers follow `current_version`.

    The rows go to a folder of their own, which counts only once the commit file of the version exists. That file is created
    whole and once, so of two writers of one version the second gets a VersionConflict and its folder goes. `token` names the
    run that wrote the version (see `version_of`).
    """
    spark = rows.sparkSession
    folder = f"v={version:08d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    try:
        commit_version(spark, root, version, folder=folder, token=token)
    except VersionConflict:
        fs, path = _store(spark, f"{root}/{folder}")
        fs.delete(path, True)
        raise
    return f"{root}/{folder}"


def current_version(spark: SparkSession, root: str) -> int | None:
    """Latest committed version, or None."""
    done = _commits(spark, root)
    return done[0] if done else None


def version_facts(spark: SparkSession, root: str, version: int) -> dict:
    """What was committed with a version."""
    return _commit(spark, root, version)


def version_of(spark: SparkSession, root: str, token: str) -> int | None:
    """The version that the run named `token` committed, or None. Looks from the newest on."""
    return next((v for v in _commits(spark, root) if _commit(spark, root, v).get("token") == token), None)


def read_version(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """The latest version, or a given one (0: the state before the first)."""
    version = current_version(spark, root) if version is None else version
    if not version:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{_commit(spark, root, version)['folder']}")


def update_version(spark: SparkSession, root: str, schema, change: Callable[[DataFrame], DataFrame], token: str = "", attempts: int = 20) -> int:
    """Commit `change(state)` as the next version, on top of whatever other writers commit meanwhile.

    A writer that comes second reads the new state and applies its change again, so no update is lost. A run that is
    repeated with its `token` changes nothing if it was committed. Returns the version.
    """
    for _ in range(attempts):
        done = version_of(spark, root, token) if token else None
        if done:
            return done
        base = current_version(spark, root) or 0
        try:
            write_version(change(read_version(spark, root, schema, base)), root, base + 1, token)
            return base + 1
        except VersionConflict:
            continue
    raise VersionConflict(f"{root}: no commit in {attempts} attempts")
