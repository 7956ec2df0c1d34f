"""Times, business weeks and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsieve.functions.bind import let
from feedsieve.functions.text import strip

# Business zone, its constant offset and the weekly cut (Sunday 22:00 local).
ZONE = "Asia/Shanghai"
WEEK_OFFSET = "86 hours"  # first Sunday 14:00 UTC after the epoch
WEEK_SECONDS = 7 * 86400
WEEK_ORIGIN = 86 * 3600
SHORT_MINUTES = 15


def parse_rfc2822(text: Column) -> Column:
    """RFC-2822 text to an instant; anything else gives null."""
    bare = F.regexp_replace(strip(text), r"^[A-Za-z]{3},?\s*", "")
    patterns = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z",
                "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")
    return let(bare, lambda b: F.coalesce(*[F.try_to_timestamp(b, F.lit(p)) for p in patterns]))


def parse_iso(text: Column) -> Column:
    """ISO text to an instant; naive times are UTC."""
    bare = strip(text)
    # Only date-led text: casting alone would also accept bare times and years.
    return let(bare, lambda b: F.when(b.rlike(r"^\d{4}-\d{2}-\d{2}"), b.try_cast("timestamp")))


def rfc_offset(text: Column) -> Column:
    """Zone offset of an RFC-2822 text as '+hhmm'; names and absence give '+0000'."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"([+-]\d{4})\s*$", 1), F.lit("")), F.lit("+0000"))


def _offset_seconds(offset: Column) -> Column:
    minutes = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int")
    return F.when(F.startswith(offset, F.lit("-")), -minutes).otherwise(minutes) * 60


def publish_fields(raw: Column) -> Column:
    """struct(date, iso): date and ISO time with offset in the feed's own zone; empty when unreadable."""
    parsed = F.struct(parse_rfc2822(raw).alias("at"), rfc_offset(strip(raw)).alias("offset"))

    def fields(p: Column) -> Column:
        local = F.timestamp_seconds(F.unix_timestamp(p["at"]) + _offset_seconds(p["offset"]))
        return F.struct(
            F.coalesce(F.date_format(local, "yyyy-MM-dd"), F.lit("")).alias("date"),
            F.coalesce(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), p["offset"]), F.lit("")).alias("iso"))

    return let(parsed, fields)


def instant(text: Column) -> Column:
    """RFC-2822 first, then ISO."""
    return let(text, lambda t: F.coalesce(parse_rfc2822(t), parse_iso(t)))


def normalize_publish_time(candidates: list[Column]) -> Column:
    """First readable of the candidate fields, as ISO text in UTC."""
    at = F.coalesce(*[instant(c) for c in candidates])
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))


def week_start(at: Column) -> Column:
    """Start instant of the business week that holds an instant."""
    secs = F.unix_seconds(at)
    return F.timestamp_seconds(secs - F.pmod(secs - F.lit(WEEK_ORIGIN), F.lit(WEEK_SECONDS)))


def week_id(start: Column) -> Column:
    """ISO week label of a week start, anchored two hours in so that Sunday 22:00 counts as Monday."""
    local = F.from_utc_timestamp(start, ZONE) + F.expr("INTERVAL 2 HOURS")
    return F.concat(F.extract(F.lit("YEAROFWEEK"), local).cast("string"), F.lit("W"),
                    F.lpad(F.weekofyear(local).cast("string"), 2, "0"))


def completed_week(now: Column) -> Column:
    """(start, end, id) of the latest week already over at an instant."""
    end = week_start(now)
    start = end - F.expr("INTERVAL 7 DAYS")
    return F.struct(start.alias("start"), end.alias("end"), week_id(start).alias("week_id"))


def in_window(at_text: Column, date_text: Column, start: Column, end: Column) -> Column:
    """Half-open test on the instant; without a time text, on date strings; unreadable is out."""
    at = instant(at_text)
    day = F.left(F.coalesce(date_text, F.lit("")), F.lit(10))
    by_date = (day != "") & (day >= F.date_format(F.from_utc_timestamp(start, ZONE), "yyyy-MM-dd")) & (
        day < F.date_format(F.from_utc_timestamp(end, ZONE), "yyyy-MM-dd"))
    has_time = F.coalesce(at_text, F.lit("")) != ""
    return F.coalesce(F.when(has_time, (at >= start) & (at < end)).otherwise(by_date), F.lit(False))


def duration_seconds(text: Column) -> Column:
    """ISO 8601 time part, H:M:S, M:S or plain seconds; anything else is 0."""
    iso = r"(?i)^P(?:\d+D)?T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    whole = r"^\s*[+-]?\d+\s*$"

    def read(value: Column) -> Column:
        def iso_part(n: int) -> Column:
            return F.coalesce(F.nullif(F.regexp_extract(value, iso, n), F.lit("")).try_cast("bigint"), F.lit(0))

        def clock(parts: Column) -> Column:
            at = [F.get(parts, F.lit(i)) for i in range(3)]  # an unreadable part is null and nulls the sum
            return F.when(F.size(parts) == 3, at[0] * 3600 + at[1] * 60 + at[2]).when(F.size(parts) == 2, at[0] * 60 + at[1])

        parts = F.transform(F.split(value, ":", -1), lambda p: F.when(p.rlike(whole), strip(p).try_cast("bigint")))
        seconds = (
            F.when(value.rlike(iso) & value.rlike(r"(?i)\d[HMS]"), iso_part(1) * 3600 + iso_part(2) * 60 + iso_part(3))
            .when(F.contains(value, F.lit(":")), let(parts, clock))
            .when(value.rlike(whole), F.greatest(F.lit(0), value.try_cast("bigint")))
        )
        return F.coalesce(seconds, F.lit(0))

    return let(strip(F.coalesce(text, F.lit(""))), read)


def format_duration(seconds: Column, minutes: Column, short_minutes: int = SHORT_MINUTES) -> Column:
    secs = F.greatest(F.coalesce(seconds.cast("bigint"), F.lit(0)), F.lit(0))
    mins = F.greatest(F.coalesce(minutes.cast("bigint"), F.lit(0)), F.lit(0))
    whole = F.floor(secs / 60).cast("string")
    return (
        F.when((secs > 0) & (secs < max(1, short_minutes) * 60),
               F.concat(whole, F.lit("分"), F.lpad((secs % 60).cast("string"), 2, "0"), F.lit("秒（短节目）")))
        .when(secs > 0, F.concat(whole, F.lit("分钟")))
        .when(mins > 0, F.concat(mins.cast("string"), F.lit("分钟")))
        .otherwise(F.lit("时长未知"))
    )


def format_window_time(text: Column) -> Column:
    """Wall-clock minutes of an ISO text in its own zone; unreadable text is cut to 16 characters."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:?\d{2}|Z)?)?$"

    def shown(value: Column) -> Column:
        clock = F.coalesce(F.nullif(F.substring(value, 12, 5), F.lit("")), F.lit("00:00"))
        return (
            F.when(value == "", F.lit(""))
            .when(value.rlike(shape) & parse_iso(value).isNotNull(), F.concat(F.left(value, F.lit(10)), F.lit(" "), clock))
            .otherwise(F.replace(F.left(value, F.lit(16)), F.lit("T"), F.lit(" ")))
        )

    return let(F.coalesce(text, F.lit("")), shown)


def format_publish_date(text: Column) -> Column:
    """RFC-2822 time as a business-zone date; any other text stays as it is."""
    local = F.from_utc_timestamp(parse_rfc2822(text), ZONE)
    return F.coalesce(F.date_format(local, "yyyy-MM-dd"), text)
