"""Versions committed once, the registry in segments, ordered duplicates on a stream, and a weekly run that fails and is repeated."""

import datetime
import glob
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from feedsieve.operators import ranking
from feedsieve.plans import weekly
from feedsieve.plans.adapters import TEST_POLICY, episodes
from feedsieve.session import new_folder
from feedsieve.sources import runs
from feedsieve.streaming import stream as st

COUNTS = "key string, n bigint"


def add(spark, key, n=1):
    def change(state):
        return state.unionByName(spark.createDataFrame([(key, n)], COUNTS)).groupBy("key").agg(F.sum("n").alias("n"))

    return change


def test_one_of_two_writers_commits(spark):
    root = new_folder(spark, "state")
    rows = spark.createDataFrame([("a", 1)], COUNTS)
    runs.write_version(rows, root, 1, "first")
    with pytest.raises(runs.VersionConflict):
        runs.write_version(rows.withColumn("n", F.lit(9).cast("bigint")), root, 1, "second")
    assert [tuple(r) for r in runs.read_version(spark, root, COUNTS).collect()] == [("a", 1)]
    assert len(glob.glob(f"{root}/v=*")) == 1 and not glob.glob(f"{root}/_commits/*.*")  # nothing of the second is left
    assert runs.version_of(spark, root, "first") == 1 and runs.version_of(spark, root, "second") is None
    assert runs.read_version(spark, root, COUNTS, 0).count() == 0


def test_writers_at_once_lose_no_update(spark):
    root = new_folder(spark, "state")
    failed = []

    def work(i):
        try:
            for k in range(3):
                runs.update_version(spark, root, COUNTS, add(spark, f"k{k}"), f"{i}/{k}")
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and runs.current_version(spark, root) == 9
    assert {r.key: r.n for r in runs.read_version(spark, root, COUNTS).collect()} == {"k0": 3, "k1": 3, "k2": 3}
    # A run that is repeated changes nothing.
    assert runs.update_version(spark, root, COUNTS, add(spark, "k0", 100), "1/1") <= 9 and runs.current_version(spark, root) == 9


def test_a_version_without_its_commit_does_not_count(spark):
    root = new_folder(spark, "state")
    runs.write_version(spark.createDataFrame([("a", 1)], COUNTS), root, 1)
    spark.createDataFrame([("a", 2)], COUNTS).write.parquet(f"{root}/v=00000002-gone")  # a writer that died
    assert runs.current_version(spark, root) == 1 and runs.read_version(spark, root, COUNTS).first().n == 1
    runs.write_version(spark.createDataFrame([("a", 3)], COUNTS), root, 2)
    assert runs.read_version(spark, root, COUNTS).first().n == 3


BATCH = "episode_id string, ts timestamp, seq bigint, decision string"


def batch(spark, rows):
    return spark.createDataFrame([(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m), s, d) for k, m, s, d in rows], BATCH)


def state_of(df):
    return {r.episode_id: (r.first_seen, r.last_seen, r.seen_count, r.decision, r.last_seq) for r in df.collect()}


def test_registry_of_batches_equals_one_batch(spark):
    rng, root, rows = random.Random(4), new_folder(spark, "registry"), []
    for b in range(7):
        mine = [(f"e{rng.randrange(60)}", rng.randrange(50_000), b * 100 + i if b != 4 else i - 1000, rng.choice("xyz")) for i in range(rng.choice([0, 3, 40]))]
        if b == 2:
            mine += [("hot", i, 250 + i, "h") for i in range(300)]
        rows += mine
        st.apply_batch(batch(spark, mine), root, b, buckets=4)
        want = state_of(st.merge_registry(spark.createDataFrame([], st.REGISTRY), batch(spark, rows)))
        assert state_of(st.read_registry(spark, root)) == want, b
        # The same batch once more, and one long done: nothing changes.
        st.apply_batch(batch(spark, mine), root, b, buckets=4)
        st.apply_batch(batch(spark, rows[:1]), root, 0, buckets=4)
        assert runs.current_version(spark, root) == b + 1 and state_of(st.read_registry(spark, root)) == want
    some = {k: v for k, v in want.items() if k in {r.episode_id for r in st.read_registry(spark, root, buckets=[1]).collect()}}
    assert some and state_of(st.read_registry(spark, root, buckets=[1])) == some


def test_registry_writes_follow_the_batch(spark):
    root = new_folder(spark, "registry")

    def written(version):
        return sum(os.path.getsize(f) for f in glob.glob(f"{root}/data/v={version:08d}-*/bucket=*/*.parquet")), {f.split("bucket=")[1].split("/")[0] for f in glob.glob(f"{root}/data/v={version:08d}-*/bucket=*/*.parquet")}

    st.apply_batch(batch(spark, [(f"e{i}", i, i, "x") for i in range(20_000)]), root, 0, buckets=4)
    for b in range(1, 9):
        st.apply_batch(batch(spark, [(f"n{b}", b, 30_000 + b, "y"), (f"e{b}", b, 40_000 + b, "z")]), root, b, buckets=4)
        size, buckets = written(b + 1)
        assert size < written(1)[0] / 20 and len(buckets) <= 2
    assert all(len([s for s in st.registry_segments(spark, root) if s["bucket"] == k]) <= 6 for k in range(4))
    got = state_of(st.read_registry(spark, root))
    assert len(got) == 20_008 and got["e3"][2:] == (2, "z", 40_003) and got["n8"][2:4] == (1, "y") and got["e9"][2] == 1


def test_a_backlog_is_drained_in_a_bounded_number_of_batches(spark):
    landed, root = new_folder(spark, "landed"), new_folder(spark, "registry")
    rows = batch(spark, [(f"e{i % 70}", i, i, "xyz"[i % 3]) for i in range(400)])
    rows.coalesce(1).write.option("maxRecordsPerFile", 4).parquet(landed)
    share = st.files_per_batch(spark, landed, rows.schema, least=2)
    assert share == 5 and st.files_per_batch(spark, landed, rows.schema, least=9) == 9
    st.stream_registry(st.read_stream(spark, landed, rows.schema, files_per_batch=share), root, buckets=2)
    assert runs.current_version(spark, root) == 20 <= st.BACKLOG_BATCHES
    assert state_of(st.read_registry(spark, root)) == state_of(st.merge_registry(spark.createDataFrame([], st.REGISTRY), rows))


def test_a_batch_that_died_before_its_commit(spark, monkeypatch):
    root = new_folder(spark, "registry")
    st.apply_batch(batch(spark, [("a", 1, 1, "x")]), root, 0)

    def dies(*args, **facts):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(runs, "commit_version", dies)
        with pytest.raises(RuntimeError):
            st.apply_batch(batch(spark, [("a", 2, 2, "y")]), root, 1)
    assert state_of(st.read_registry(spark, root))["a"][2] == 1
    st.apply_batch(batch(spark, [("a", 2, 2, "y")]), root, 1)
    assert state_of(st.read_registry(spark, root))["a"][2:] == (2, "y", 2)


def test_stream_dedup_by_order_equals_batch(spark):
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = []
    for i in range(600):
        at = start + datetime.timedelta(minutes=rng.randrange(6 * 1440))
        rows.append((f"t{rng.randrange(25)}", at, at.strftime("%Y-%m-%d"), rng.randrange(5), i))
    end = start + datetime.timedelta(days=30)
    rows.append(("end", end, end.strftime("%Y-%m-%d"), 0, 10_000))
    schema = "episode_title string, ts timestamp, publish_date string, feed_ord int, item_pos int"
    whole = spark.createDataFrame(rows, schema)
    want = {r.item_pos for r in ranking.dedup_cross_feed(whole).collect()} - {10_000}
    for seed, files in ((1, 3), (2, 5)):
        mixed = rows[:-1]
        random.Random(seed).shuffle(mixed)
        landed = new_folder(spark, "landed")
        step = -(-len(mixed) // files)
        for i in range(files):
            spark.createDataFrame(mixed[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(landed)
        spark.createDataFrame(rows[-1:], schema).coalesce(1).write.mode("append").parquet(landed)
        # Every file holds items of all days: all stay open until the last item moves the watermark.
        once = st.first_by_order(st.read_stream(spark, landed, whole.schema, files_per_batch=1), "ts", ["episode_title"], ["feed_ord", "item_pos"], "7 days")
        got = [r.item_pos for r in spark.read.schema(once.schema).parquet(st.drain_to_table(once, "first")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def tables(spark, root):
    read = lambda name, schema: sorted(map(str, spark.read.schema(schema).parquet(f"{root}/{name}").collect()))
    registry = {r.episode_id: (r.seen_count, list(r.statuses)) for r in runs.read_version(spark, f"{root}/registry", weekly.REGISTRY).collect()}
    return (registry, read("log", "total bigint, full bigint, preview bigint, skip bigint, week_id string, run_id string"),
            read("report", "line_no bigint, line string, week_id string, run_id string"), read("runs", "item_pos bigint, decision string, seen_count int, week_id string, run_id string"))


def test_a_weekly_run_repeated_after_any_failure(spark, monkeypatch):
    eps = episodes(spark, "/root/testdata/sf0.001").where("item_pos < 40")
    hosts = spark.createDataFrame([("Show src1", "Host One")], "podcast_name string, host string")

    def run(root, at="2024-02-05"):
        return weekly.run_week(eps, TEST_POLICY, hosts, root, at)

    plain = new_folder(spark, "weekly")
    run(plain)
    want = tables(spark, plain)
    assert set(v[0] for v in want[0].values()) == {1} and len(want[1]) == len({x for x in want[1]}) > 1 and want[2]
    run(plain)
    assert tables(spark, plain) == want and runs.current_version(spark, f"{plain}/registry") == 1
    for name in ("write_version", "write_run_result", "replace_rows"):
        root = new_folder(spark, "weekly")
        calls = []

        def fails(*args, _name=name, _real=getattr(runs, name), **more):
            calls.append(_name)
            if _name == "replace_rows" and len(calls) == 1:
                return _real(*args, **more)  # the log is written, the report is not
            raise RuntimeError(f"lost in {_name}")

        with monkeypatch.context() as m:
            m.setattr(runs, name, fails)
            with pytest.raises(RuntimeError, match="lost"):
                run(root)
        run(root)
        assert tables(spark, root) == want, name
    run(plain, "2024-02-12")
    assert set(v[0] for v in tables(spark, plain)[0].values()) == {2} and tables(spark, plain)[1] == want[1]


def test_translations_are_kept_for_the_next_run(spark, tmp_path):
    text = "This episode discusses energy markets and policy in enough English words to be translated for display today, with number {}."
    rows = [(i, 0, "p", "Show p", "en", 1800, 30, f"http://a/{i}.mp3", f"Title {i}", text.format(i), "2024-01-03", "2024-01-03T00:00:00Z", datetime.datetime(2024, 1, 3), datetime.datetime(2023, 12, 31, 14), "2024W01", "run_2024W01") for i in range(3)]
    items = spark.createDataFrame(rows, "item_pos bigint, feed_ord int, podcast_id string, podcast_name string, language string, duration_seconds int, duration_minutes int, audio_url string, "
                                  "episode_title string, show_notes string, publish_date string, pub_datetime string, pub_ts timestamp, week_start timestamp, week_id string, run_id string")
    hosts = spark.createDataFrame([], "podcast_name string, host string")
    log = str(tmp_path / "calls")

    def call(chunk, target):
        with open(log, "a") as f:
            f.write("x\n")
        return "译文 " + chunk[-3:]

    root = new_folder(spark, "weekly")
    weekly.run_week(items, TEST_POLICY, hosts, root, "2024-01-08", call)
    first = open(log).read().count("x")
    lines = [r.line for r in spark.read.parquet(f"{root}/report").orderBy("line_no").collect()]
    assert first == 3 and sum(x.startswith("译文") for x in lines) == 3 and sum(x.startswith("### ") for x in lines) == 3
    weekly.run_week(items, TEST_POLICY, hosts, root, "2024-01-15", call)
    assert open(log).read().count("x") == first
