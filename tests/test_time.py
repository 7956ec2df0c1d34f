from pyspark.sql import functions as F

from feedsieve.functions import when

T = F.col("t")


def test_completed_week_at_the_cut(each):
    cases = {
        "2026-05-04T09:00:00+08:00": "2026W18", "2026-05-10T21:59:59+08:00": "2026W18", "2026-05-10T22:00:00+08:00": "2026W19",
        "2026-05-10T23:26:00+08:00": "2026W19", "2026-05-11T09:00:00+08:00": "2026W19", "2026-05-17T21:59:59+08:00": "2026W19",
        "2026-05-17T22:00:00+08:00": "2026W20", "2027-01-10T22:00:00+08:00": "2027W01", "2027-01-03T22:00:00+08:00": "2026W53"}
    got = each(list(cases), when.completed_week(when.instant(T))["week_id"])
    assert got == list(cases.values())


def test_completed_week_bounds(one):
    start, end = one("2026-05-04T09:00:00+08:00", F.date_format(when.completed_week(when.instant(T))["start"], "yyyy-MM-dd HH:mm"),
                     F.date_format(when.completed_week(when.instant(T))["end"], "yyyy-MM-dd HH:mm"))
    assert (start, end) == ("2026-04-26 14:00", "2026-05-03 14:00")


def test_window_is_half_open(spark):
    start, end = (F.lit(s).cast("timestamp") for s in ("2026-05-24 14:00:00", "2026-05-31 14:00:00"))
    cases = [("2026-05-24T22:00:00+0800", "", True), ("2026-05-31T21:59:58+0800", "", True), ("2026-05-31T22:00:00+0800", "", False),
             ("2026-05-31T22:00:01+0800", "", False), ("2026-05-24T21:59:59+0800", "", False), ("Wed, 27 May 2026 02:00:00 GMT", "", True),
             ("", "2026-05-24", True), ("", "2026-05-31", False), ("", "", False), ("rubbish", "2026-05-26", False), ("2026-05-27T02:00:00Z", "", True)]
    rows = spark.createDataFrame([(i, a, d) for i, (a, d, _) in enumerate(cases)], "i int, a string, d string")
    got = [r[1] for r in sorted(rows.select("i", when.in_window(F.col("a"), F.col("d"), start, end)).collect())]
    assert got == [c[2] for c in cases]


def test_durations(each):
    cases = {"12:30": 750, "06:07": 367, "678": 678, "PT1H02M03S": 3723, "PT34M12S": 2052, "PT45M": 2700, "PT59S": 59, "00:42:00": 2520, "P1DT2H": 7200,
             "": 0, "x": 0, "-5": 0, "1:2:3:4": 0, "PT": 0, "a:10": 0, " 90 ": 90}
    assert each(list(cases), when.duration_seconds(T)) == list(cases.values())


def test_publish_fields(one):
    assert tuple(one("Wed, 27 May 2026 02:00:00 GMT", when.publish_fields(T))) == ("2026-05-27", "2026-05-27T02:00:00+0000")
    assert tuple(one("27 May 2026 02:00:00 -0530", when.publish_fields(T))) == ("2026-05-27", "2026-05-27T02:00:00-0530")
    assert tuple(one("not a date", when.publish_fields(T))) == ("", "")


def test_duration_label(spark):
    rows = [(0, 0, "时长未知"), (0, 12, "12分钟"), (65, 0, "1分05秒（短节目）"), (899, 0, "14分59秒（短节目）"), (900, 0, "15分钟"), (None, None, "时长未知")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, s int, m int")
    assert [r[1] for r in sorted(df.select("i", when.format_duration(F.col("s"), F.col("m"))).collect())] == [r[2] for r in rows]


def test_window_time_text(one):
    assert one("2026-04-26T22:00:00+0800", when.format_window_time(T)) == "2026-04-26 22:00"
    assert one("week of something long", when.format_window_time(T)) == "week of somethin"
