"""Failing feeds, items stored by day, and names of many alike hosts."""

import datetime
import hashlib
import random

from pyspark.sql import functions as F

from feedsieve.operators import joins
from feedsieve.session import new_folder
from feedsieve.sources import feeds

GOOD = "<rss><item><title>A</title></item><item><title>B</title></item></rss>"


def page(text):
    return f'<script type="application/ld+json">{text}</script>'


def test_failing_feeds_give_error_rows_and_others_go_on(spark):
    bodies = [("good", "rss", GOOD), ("none", "rss", None), ("blank", "rss", " \n"), ("cut", "rss", GOOD.replace("</rss>", "<item><title>C")), ("swallowed", "rss", "<item><title>A</title><item><title>B</title></item>"),
              ("bare", "rss", "<rss/>"), ("other", "atom", "<feed/>"), ("untyped", None, GOOD), ("json", "html_jsonld", page('{"workExample":[{"name":"X"}]}')), ("nojson", "html_jsonld", "<html/>"),
              ("badjson", "apple_jsonld", page('{"workExample":[{"name":"X"')), ("emptyjson", "apple_jsonld", page('{"workExample":[]}')), ("alien", "apple_jsonld", page('{"name":"X"}'))]
    frame = spark.createDataFrame(bodies, "podcast_name string, feed_type string, body string")
    got = {r.podcast_name: (r.reason, r.corrupt_record) for r in feeds.quarantine(frame).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "none": "empty body", "blank": "empty body", "cut": "unfinished item", "swallowed": "unfinished item", "bare": "no items", "other": "no items", "nojson": "no data script",
        "badjson": "broken data script", "emptyjson": "no items", "alien": "no items"}
    assert all(got[n][1] == b for n, _, b in bodies if n in got)  # kept whole
    items = {r.podcast_name: r["count"] for r in feeds.scan_feeds_by_type(frame).groupBy("podcast_name").count().collect()}
    assert items == {"good": 2, "cut": 2, "swallowed": 1, "untyped": 2, "json": 1}
    registry = spark.createDataFrame([("1", "good", "http://a", "rss", "en"), ("2", "gone", "http://b", "rss", "en"), ("3", "off", "", "rss", "en")], "id string, name string, rss_url string, feed_type string, language string")
    errors = {(r.name, r.reason, r.bodies) for r in feeds.feed_errors(registry, frame).collect()}
    assert ("gone", "nothing landed", 0) in errors and ("cut", "unfinished item", 1) in errors and not {n for n, _, _ in errors} & {"good", "off", "json"}
    assert feeds.feed_errors(registry.limit(0), frame.limit(0)).count() == 0


def test_scans_read_the_days_they_need(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i)) for i in range(24 * 30)] + [(9999, None)]
    path = new_folder(spark, "landed")
    feeds.land_items(spark.createDataFrame(rows, "item_pos long, pub_ts timestamp"), path)
    landed = feeds.read_landed(spark, path, "item_pos long, pub_ts timestamp")
    low, high = start + datetime.timedelta(days=6, hours=14), start + datetime.timedelta(days=13, hours=14)
    week = feeds.landed_week(landed, *[F.lit(t).cast("timestamp") for t in (low, high)])
    assert sorted(r.item_pos for r in week.collect()) == [i for i, t in rows if t and low <= t < high]
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pub_day" in plan and "pub_day#" in plan
    assert len(week.inputFiles()) >= 8 * 1 and len({f.split("pub_day=")[1].split("/")[0] for f in landed.inputFiles()}) == 31
    runs = spark.createDataFrame([("r1", low, high, 1), ("r2", high, high + datetime.timedelta(days=7), 0)], "run_id string, window_start timestamp, window_end timestamp, wanted int").where("wanted = 1")
    some = feeds.landed_in_runs(landed, runs)
    assert sorted(r.item_pos for r in some.collect()) == [i for i, t in rows if t and low <= t < high] and {r.run_id for r in some.collect()} == {"r1"}
    assert "dynamicpruning" in some._jdf.queryExecution().toString().lower()
    # A day that lands again is replaced, the others stay.
    feeds.land_items(spark.createDataFrame([(5, start)], "item_pos long, pub_ts timestamp"), path)
    again = feeds.read_landed(spark, path, "item_pos long, pub_ts timestamp")
    assert again.count() == len(rows) - 23


def test_alike_hosts_do_not_meet_in_one_key(spark):
    rng = random.Random(5)
    hosts = [("s", f"Professor Doctor {rng.randrange(10**6):06d}") for _ in range(3000)] + [("t", "Ann"), ("t", "Bo"), ("t", None), (None, "Ann")]
    names = [("s", h) for _, h in rng.sample(hosts[:3000], 40)] + [("s", "Dr " + h + " jr") for _, h in rng.sample(hosts[:3000], 40)] + [("s", h[-6:]) for _, h in rng.sample(hosts[:3000], 40)]
    names += [("s", "Professor Doctor"), ("s", "Professor Miller"), ("s", "ofes"), ("s", "fe"), ("s", "xyz"), ("t", "Anna"), ("t", "an"), ("t", "ann"), ("t", "bo"), ("t", "Bob"), ("t", None), ("t", ""), (None, "ann"), ("u", "Ann")]
    got = joins.with_host_flag(spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "i int, podcast_name string, name string"), spark.createDataFrame(hosts, "podcast_name string, host string")).collect()

    def is_host(feed, name):
        low = (name or "").strip().lower()
        mine = [h.strip().lower() for f, h in hosts if f == feed and f is not None and h is not None]
        return bool(name is not None and (low in mine or any(len(h) >= 3 and h in low or len(low) >= 3 and low in h for h in mine)))

    assert len(got) == len(names) and {r.i: r.is_host for r in got} == {i: is_host(*n) for i, n in enumerate(names)}
    theirs = spark.createDataFrame(hosts[:3000], "podcast_name string, host string").select("podcast_name", F.lower("host").alias("_host")).distinct()
    grams = theirs.select("podcast_name", "_host", F.explode(joins._grams(F.col("_host"), 3)).alias("k"))
    chosen = joins._rarest(theirs, grams.groupBy("podcast_name", "k").agg(F.count("*").alias("n")), "_host").groupBy("k").count()
    most, mean = chosen.agg(F.max("count"), F.avg("count")).first()
    assert most < 10 * mean


def test_digests_of_small_and_streamed_files(spark, tmp_path):
    """Both ways give the same digests; a file that is streamed is never read as a row."""
    rng = random.Random(3)
    contents = {"a.bin": b"", "b c.bin": b"x", "d%20é.bin": rng.randbytes(1000), "sub/e.bin": rng.randbytes(9 << 20), "sub/f.txt": b"other"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    want = sorted((n.split("/")[-1], len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if n.endswith(".bin") and c)
    for row_bytes in (0, 500, feeds.ROW_BYTES):
        got = feeds.scan_binary_digests(spark, str(tmp_path), "*.bin", row_bytes)
        assert sorted(tuple(r) for r in got.collect()) == want
    with open(tmp_path / "huge.big", "wb") as f:
        f.truncate((2 << 30) + 10)  # beyond what one row can hold
    huge = feeds.scan_binary_digests(spark, str(tmp_path), "*.big").first()
    zeros = hashlib.sha256()
    for _ in range(2048):
        zeros.update(bytes(1 << 20))
    zeros.update(bytes(10))
    assert (huge.length, huge.sha256) == ((2 << 30) + 10, zeros.hexdigest())
