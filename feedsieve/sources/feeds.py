"""Reading landed feed bodies, registries, state files and binaries.

Feed bodies arrive landed as rows (feed name, type, body); nothing is fetched. A body that cannot be
read gives no rows and never fails the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsieve import schemas
from feedsieve.functions.bind import let
from feedsieve.functions.items import select_longest_text
from feedsieve.functions.text import strip
from feedsieve.functions.when import duration_seconds, publish_fields

# Item and field patterns of a feed body.
ITEM = r"(?s)<item>(.*?)</item>"
TITLE = r"<title><!\[CDATA\[(.*?)\]\]></title>|<title>(.*?)</title>"
PUB_DATE = r"<pubDate>(.*?)</pubDate>"
DURATION = r"<itunes:duration>(.*?)</itunes:duration>"
ENCLOSURE = r'<enclosure[^>]+url="([^"]+)"'
GUID = r"(?s)<guid[^>]*>(.*?)</guid>"
TEXT_FIELDS = ("description", "content:encoded", "itunes:summary", "itunes:subtitle")
JSONLD_SCRIPT = r'(?s)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'


def _either(text: Column, pattern: str) -> Column:
    """CDATA form or plain form, whichever matched first; searched a second time only where the first form gives nothing."""
    return strip(let(F.regexp_extract(text, pattern, 1), lambda cdata: F.when(cdata != "", cdata).otherwise(F.regexp_extract(text, pattern, 2))))


def _text_field(item: Column, tag: str) -> Column:
    # Most items lack some fields; a plain search tells.
    return F.when(F.contains(item, F.lit(f"<{tag}")), _either(item, rf"(?s)<{tag}[^>]*>\s*<!\[CDATA\[(.*?)\]\]>\s*</{tag}>|<{tag}[^>]*>(.*?)</{tag}>")).otherwise("")


def explode_items(bodies: DataFrame, pattern: str = ITEM, body: str = "body") -> DataFrame:
    """One row per item of a body, in order (item_no from 0); the body itself is not carried along."""
    keep = [c for c in bodies.columns if c != body]
    return bodies.select(*keep, F.posexplode(F.regexp_extract_all(body, F.lit(pattern), F.lit(1))).alias("item_no", "item"))


def _item_columns(raw_fields: list[str], title: str, date: str, iso: str, duration: str, audio: str) -> list[Column]:
    return [
        F.col(title).alias("episode_title"), F.col(date).alias("publish_date"), F.col(iso).alias("pub_datetime"),
        F.col("pub_date_raw"), F.col(duration).alias("duration_seconds"),
        F.floor(F.col(duration) / 60).alias("duration_minutes"), F.col(audio).alias("audio_url"),
        select_longest_text([F.col(c) if c else F.lit("") for c in raw_fields]).alias("best"),
    ]


def scan_feed_items(bodies: DataFrame) -> DataFrame:
    """Items of RSS bodies: title, times, duration, best text and audio address."""
    keep = [c for c in bodies.columns if c != "body"]
    item = F.col("item")
    fields = explode_items(bodies).select(
        *keep, "item_no", _either(item, TITLE).alias("title"), strip(F.regexp_extract(item, PUB_DATE, 1)).alias("pub_date_raw"),
        duration_seconds(F.regexp_extract(item, DURATION, 1)).alias("secs"), F.regexp_extract(item, ENCLOSURE, 1).alias("audio"),
        *[_text_field(item, t).alias(f"raw{i}") for i, t in enumerate(TEXT_FIELDS)])
    dated = fields.withColumn("pub", publish_fields(F.col("pub_date_raw"))).withColumns({"d": F.col("pub.date"), "iso": F.col("pub.iso")})
    cols = _item_columns([f"raw{i}" for i in range(4)], "title", "d", "iso", "secs", "audio")
    return dated.select(*keep, "item_no", *cols).select("*", "best.*").drop("best")


def scan_enclosure_items(bodies: DataFrame) -> DataFrame:
    """Light item scan: only items with an enclosure; guid and date fall back to what there is."""
    keep = [c for c in bodies.columns if c != "body"]
    item = F.col("item")
    raw = strip(F.regexp_extract(item, PUB_DATE, 1))
    out = explode_items(bodies).withColumn("enclosure_url", F.regexp_extract(item, ENCLOSURE, 1)).filter(F.col("enclosure_url") != "")
    guid = F.when(item.rlike(GUID), strip(F.regexp_extract(item, GUID, 1))).otherwise(F.col("enclosure_url"))
    return out.select(
        *keep, "item_no", _either(item, TITLE).alias("title"),
        F.coalesce(F.nullif(publish_fields(raw)["date"], F.lit("")), F.left(raw, F.lit(16))).alias("pub_date"),
        "enclosure_url", guid.alias("guid"))


def scan_jsonld_items(bodies: DataFrame) -> DataFrame:
    """Items of the first ld+json script of a page; unreadable JSON gives no rows."""
    keep = [c for c in bodies.columns if c != "body"]
    script = F.regexp_extract("body", JSONLD_SCRIPT, 1)
    page = F.from_json(F.when(script != "", script), schemas.JSONLD_PAGE, {"mode": "PERMISSIVE"})
    rows = bodies.select(*keep, F.posexplode(page["workExample"]).alias("item_no", "ep")).filter(F.col("ep").isNotNull())
    text = {n: F.coalesce(F.col(f"ep.{n}"), F.lit("")) for n in ("name", "datePublished", "duration", "description")}
    flat = rows.select(
        *keep, "item_no", text["name"].alias("title"), F.left(text["datePublished"], F.lit(10)).alias("d"),
        text["datePublished"].alias("pub_date_raw"), duration_seconds(text["duration"]).alias("secs"),
        F.coalesce(F.get(F.col("ep.offers"), F.lit(0))["url"], F.lit("")).alias("audio"), text["description"].alias("raw0"))
    cols = _item_columns(["raw0", "", "", ""], "title", "d", "pub_date_raw", "secs", "audio")
    return flat.select(*keep, "item_no", *cols).select("*", "best.*").drop("best")


def scan_feeds_by_type(bodies: DataFrame) -> DataFrame:
    """Items of every landed body by its feed type; unknown types are read as RSS."""
    is_page = F.col("feed_type").isin("apple_jsonld", "html_jsonld")
    return scan_feed_items(bodies.filter(~F.coalesce(is_page, F.lit(False)))).unionByName(scan_jsonld_items(bodies.filter(is_page)))


PAGE_TYPES = ("apple_jsonld", "html_jsonld")
_CHECKED_PAGE = "workExample array<struct<name:string>>, broken string"


def failure_of(body: Column, feed_type: Column) -> Column:
    """Why a landed body gives no items, or loses some; null if it gives all it has."""
    empty = strip(F.coalesce(body, F.lit(""))) == ""
    # Items that begin, and items that are whole: one that never ends swallows the next one's end.
    begun, whole = F.regexp_count(body, F.lit("<item>")), F.regexp_count(body, F.lit(ITEM))
    feed = F.when(begun == 0, "no items").when(whole < begun, "unfinished item")
    script = F.regexp_extract(body, JSONLD_SCRIPT, 1)
    page = F.from_json(script, _CHECKED_PAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    listed = F.coalesce(F.size(F.filter(page["workExample"], lambda e: e.isNotNull())), F.lit(0))
    paged = F.when(script == "", "no data script").when(page["broken"].isNotNull(), "broken data script").when(listed <= 0, "no items")
    return F.when(empty, "empty body").otherwise(F.when(F.coalesce(feed_type.isin(*PAGE_TYPES), F.lit(False)), paged).otherwise(feed))


def quarantine(bodies: DataFrame) -> DataFrame:
    """The bodies (podcast_name, feed_type, body, ...) that fail, whole, each with its reason.

    One pass over the bodies, no join; the other feeds' items come from `scan_feeds_by_type` as if these were not there. What
    an unfinished body still gives is among them.
    """
    return bodies.withColumn("reason", failure_of(F.col("body"), F.col("feed_type"))).where("reason IS NOT NULL").withColumnRenamed("body", "corrupt_record")


def feed_errors(registry: DataFrame, bodies: DataFrame) -> DataFrame:
    """(name, reason, bodies) for each registered feed that gives fewer items than it should: reasons of `quarantine`, and
    feeds with an address of which nothing landed. Feeds that are not in the registry are reported by their name too."""
    failed = quarantine(bodies).groupBy(F.col("podcast_name").alias("name"), "reason").agg(F.count("*").alias("bodies"))
    landed = bodies.select(F.col("podcast_name").alias("name")).distinct()
    missing = scan_feed_registry(registry).join(landed, "name", "left_anti").select("name", F.lit("nothing landed").alias("reason"), F.lit(0).cast("bigint").alias("bodies"))
    return failed.unionByName(missing)


def land_items(items: DataFrame, path: str, ts: str = "pub_ts", files: int = 4) -> None:
    """Store items by day of publication (`pub_day`), for scans by week; days that the items name are replaced.

    A day's items are dealt to a few files, so that a day with very many is not one task. Items without a time lie in a
    part of their own, which every scan by time skips.
    """
    spread = F.pmod(F.xxhash64(*items.columns), F.lit(files))
    rows = items.withColumn("pub_day", F.to_date(ts)).withColumn("_part", spread).repartition("pub_day", "_part").drop("_part")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pub_day").parquet(path)


def read_landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, pub_day date").parquet(path)


def landed_week(landed: DataFrame, start: Column, end: Column, ts: str = "pub_ts") -> DataFrame:
    """Items of `read_landed` inside [start, end): only the days of the window are listed and read."""
    days = (F.col("pub_day") >= F.to_date(start)) & (F.col("pub_day") <= F.to_date(end))
    return landed.where(days & (F.col(ts) >= start) & (F.col(ts) < end)).drop("pub_day")


def landed_in_runs(landed: DataFrame, runs: DataFrame, ts: str = "pub_ts") -> DataFrame:
    """Items of `read_landed` with the run (run_id, window_start, window_end) in whose window they lie.

    Runs are listed by the days they span, a few rows each, and meet the items on the day: the days that some run spans prune the
    items' folders while the query runs.
    """
    days = runs.select("run_id", "window_start", "window_end", F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end"))).alias("pub_day"))
    joined = landed.join(days, "pub_day").where((F.col(ts) >= F.col("window_start")) & (F.col(ts) < F.col("window_end")))
    return joined.drop("pub_day", "window_start", "window_end")


def scan_xml_items(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed feed files through the XML reader; every field stays text."""
    names = ("title", "pubDate", "itunes:duration", "description", "content:encoded", "itunes:summary", "itunes:subtitle", "guid")
    schema = ", ".join(f"`{n}` string" for n in names) + ", enclosure struct<_url:string>"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def scan_feed_registry(registry: DataFrame) -> DataFrame:
    """Feeds that have an address."""
    return registry.filter(F.coalesce("rss_url", F.lit("")) != "").select(
        "id", "name", "rss_url", F.coalesce("feed_type", F.lit("rss")).alias("feed_type"),
        F.coalesce("language", F.lit("zh")).alias("language"))


def feeds_without_content(registry: DataFrame, bodies: DataFrame) -> DataFrame:
    """Feeds with an address but no landed, non-empty body."""
    landed = bodies.filter(F.coalesce("body", F.lit("")) != "").select(F.col("podcast_name").alias("name")).distinct()
    return scan_feed_registry(registry).join(landed, "name", "left_anti").select("id")


def scan_jsonl_state(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines with blank or broken lines and empty keys dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.coalesce(key, F.lit("")) != "")


# Files up to this size are digested from one row each; larger ones are streamed.
ROW_BYTES = 64 << 20
_CHUNK = 4 << 20


def _streamed_digests(chunk: int = _CHUNK):
    """Digests of listed files (local, HDFS, S3 or GCS), read piece by piece."""
    def opened(path: str):
        scheme, _, rest = path.partition(":")
        if scheme == "file":
            return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
        system, inside = fs.FileSystem.from_uri(quote(path, safe="/:@"))
        return system.open_input_stream(inside)

    def digest(path: str) -> str:
        out = hashlib.sha256()
        with opened(path) as stream:
            while piece := stream.read(chunk):
                out.update(piece)
        return out.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array([digest(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=["path", "length", "sha256"])
    return run


def scan_binary_digests(spark: SparkSession, path: str, glob: str = "*", row_bytes: int = ROW_BYTES) -> DataFrame:
    """SHA-256 and size of every file below a path, of any size.

    Files up to `row_bytes` are read by Spark and digested in the JVM. A larger file never becomes a row: the task that it is dealt
    to reads it in pieces of 4 MB, as a digest needs its bytes in order. The reader's filter on the length keeps either kind
    from being opened by the other way. Empty files are not listed by the reader and give no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= row_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > row_bytes).select("path", "length").mapInArrow(_streamed_digests(), "path string, length bigint, sha256 string")
    return small.unionByName(large).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")
