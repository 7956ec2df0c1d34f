"""Lookups, keyed updates and semi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.functions.text import strip
from feedsieve.functions.when import in_window
from feedsieve.operators.ranking import first_per_key
from feedsieve.session import materialize

def join_feed_config(items: DataFrame, config: DataFrame) -> DataFrame:
    """Feed id and language by feed name; unknown feeds get a name-based id and Chinese."""
    named = config.select("podcast_name", F.col("podcast_id").alias("_id"), F.col("language").alias("_lang"))
    out = items.join(named, ["podcast_name"], "left")
    fallback = F.replace(F.lower("podcast_name"), F.lit(" "), F.lit(""))
    return out.withColumns({"podcast_id": F.coalesce("_id", fallback), "language": F.coalesce("_lang", F.lit("zh"))}).drop("_id", "_lang")


def join_registry(items: DataFrame, registry: DataFrame, run_at: str, week: Column, keep: int = 52) -> DataFrame:
    """Registry view of each item: first and last seen, count, previous decision, bounded history."""
    known = registry.select("episode_id", *[F.col(c).alias(f"_{c}") for c in (
        "first_seen", "first_seen_week_id", "seen_count", "decision", "statuses")])
    # Both sides hold one row per episode id, so the shuffle join has no hot key.
    out = items.join(known, "episode_id", "left")
    history = F.concat(F.coalesce("_statuses", F.array().cast("array<string>")), F.array("decision"))
    return out.withColumns({
        "first_seen": F.coalesce("_first_seen", F.lit(run_at)),
        "first_seen_week_id": F.coalesce("_first_seen_week_id", week),
        "last_seen": F.lit(run_at),
        "seen_count": F.coalesce("_seen_count", F.lit(0)) + 1,
        "previous_decision": F.col("_decision"),
        "statuses": F.slice(history, F.greatest(F.size(history) - (keep - 1), F.lit(1)), F.lit(keep)),
    }).drop("_first_seen", "_first_seen_week_id", "_seen_count", "_decision", "_statuses")


def upsert_registry(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Old and new records, the new one winning per episode id."""
    both = registry.withColumn("_gen", F.lit(0)).unionByName(updates.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both.filter(F.coalesce("episode_id", F.lit("")) != ""), ["episode_id"], [F.col("_gen").desc()]).drop("_gen")


def new_vs_known(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Items flagged by whether the registry holds their episode id."""
    ids = registry.select("episode_id").distinct().withColumn("_known", F.lit(True))
    return items.join(ids, "episode_id", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def exclude_hosts(names: DataFrame, hosts: DataFrame) -> DataFrame:
    """Drop names that equal, contain or are contained in a host of the same feed (3 characters or more)."""
    return with_host_flag(names, hosts).filter(~F.col("is_host")).drop("is_host")


def _rarest(texts: DataFrame, counts: DataFrame, column: str) -> DataFrame:
    """Each text of (podcast_name, column) with the one of its grams that the fewest hosts of its feed have.

    Texts with a gram that no host has are left out: no host holds them.
    """
    grams = texts.select("podcast_name", column, F.explode(_grams(F.col(column), 3)).alias("k")).join(counts, ["podcast_name", "k"], "left")
    best = grams.groupBy("podcast_name", column).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k")).alias("best"))
    return best.where("best.n > 0").select("podcast_name", column, F.col("best.k").alias("k"))


def with_host_flag(names: DataFrame, hosts: DataFrame) -> DataFrame:
    """Names flagged as hosts: those that equal, contain or are contained in a host of the same feed (3 characters or more).

    Distinct names and hosts of a feed meet by equality and by grams of three letters. How many hosts of the feed have a gram is
    counted first: where a name holds a host, all grams of the name meet that one of the host which the fewest hosts have; where
    a host holds a name, all grams of the host meet that one of the name. So a beginning or a surname that many hosts
    share brings nothing together.
    """
    mine = names.select("podcast_name", F.lower(strip(F.col("name"))).alias("_low")).distinct()
    theirs = hosts.select("podcast_name", F.lower(F.trim("host")).alias("_host")).distinct()
    grams = materialize(theirs.select("podcast_name", "_host", F.explode(_grams(F.col("_host"), 3)).alias("k")), "host-grams")
    counts = materialize(grams.groupBy("podcast_name", "k").agg(F.count("*").alias("n")), "host-gram-counts")
    equal = mine.join(theirs.withColumnRenamed("_host", "_low"), ["podcast_name", "_low"])
    asked = mine.select("podcast_name", "_low", F.explode(_grams(F.col("_low"), 3)).alias("k"))
    holds = asked.join(_rarest(theirs, counts, "_host"), ["podcast_name", "k"]).filter(F.contains("_low", F.col("_host")))
    held = _rarest(mine, counts, "_low").join(grams, ["podcast_name", "k"]).filter(F.contains("_host", F.col("_low")))
    found = equal.unionByName(holds.select("podcast_name", "_low")).unionByName(held.select("podcast_name", "_low")).distinct().withColumn("_found", F.lit(True))
    flagged = names.withColumn("_low", F.lower(strip(F.col("name")))).join(found, ["podcast_name", "_low"], "left")
    return flagged.withColumn("is_host", F.coalesce("_found", F.lit(False))).drop("_found", "_low")


def cache_ttl_lookup(requests: DataFrame, cache: DataFrame, now: Column, confirmed_days: int = 90, other_days: int = 30) -> DataFrame:
    """Cached entry per key while its age in whole days is within the limit of its status."""
    entries = cache.select("key", "cached_at", "detection_status", "payload")
    out = requests.join(entries, "key", "left")
    age = F.floor((F.unix_seconds(now) - F.unix_seconds("cached_at")) / 86400)
    limit = F.when(F.coalesce("detection_status", F.lit("confirmed_guest")) == "confirmed_guest", confirmed_days).otherwise(other_days)
    valid = F.coalesce(age <= limit, F.lit(False))
    return out.withColumns({"cache_valid": valid, "payload": F.when(valid, F.col("payload"))})


def join_folder_targets(items: DataFrame, folders: DataFrame, keys: list[str]) -> DataFrame:
    """Destination of each item; nothing configured means an empty destination, never a guess."""
    out = items.join(folders, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("folder_id", "folder_url")})


def selection_in_window(selections: DataFrame, runs: DataFrame) -> DataFrame:
    """Selections whose item time lies in the half-open window of the run they name."""
    joined = selections.join(runs.select("run_id", "window_start", "window_end"), "run_id")
    return joined.filter((F.col("published_at") >= F.col("window_start")) & (F.col("published_at") < F.col("window_end"))).drop(
        "window_start", "window_end")


def update_queue_status(queue: DataFrame, updates: DataFrame) -> DataFrame:
    """Queue with status, document and finish time replaced where an update names the selection."""
    new = updates.select("selection_id", *[F.col(c).alias(f"_{c}") for c in ("status", "doc_id", "doc_url", "finished_at")])
    out = queue.join(new, ["selection_id"], "left")
    return out.withColumns({
        "status": F.coalesce("_status", "status"),
        **{c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)) for c in ("doc_id", "doc_url", "finished_at")},
    }).drop("_status", "_doc_id", "_doc_url", "_finished_at")


def update_processing_status(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Registry with its nested processing status merged; updates of unknown episodes are ignored."""
    fields = ("selected_action", "queue_status", "preview_doc_url", "full_doc_url", "last_processed_at")
    new = updates.select("episode_id", F.struct(*fields).alias("_new"), F.lit(True).alias("_hit"))
    out = registry.join(new, "episode_id", "left")

    def merged(name: str) -> Column:
        fresh, old = F.col(f"_new.{name}"), F.col(f"processing_status.{name}")
        always = name in ("selected_action", "queue_status")
        return F.coalesce(fresh if always else F.nullif(fresh, F.lit("")), old)

    status = F.struct(*[merged(n).alias(n) for n in fields])
    return out.withColumn("processing_status", F.when(F.col("_hit"), status).otherwise(F.col("processing_status"))).drop("_new", "_hit")


FINGERPRINT = ["schema_version", "source_sha256", "backend", "model", "language_requested"]


def reusable_artifacts(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Requests flagged by whether a finished artifact with the same fingerprint and real outputs exists."""
    done = artifacts.filter((F.col("status") == "success") & (F.least("txt_bytes", "srt_bytes", "vtt_bytes") > 0))
    ready = done.select(*FINGERPRINT).distinct().withColumn("_ready", F.lit(True))
    return requests.join(ready, FINGERPRINT, "left").withColumn("reusable", F.coalesce("_ready", F.lit(False))).drop("_ready")


def notified_consistently(notifications: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Successful notifications that agree with the delivery of the same run."""
    sent = deliveries.select("run_id", F.col("week_id").alias("_week"), F.col("doc_id").alias("_doc"), F.col("doc_url").alias("_url"))
    out = notifications.join(sent, "run_id", "left")

    def agrees(mine: str, theirs: str) -> Column:
        return (F.coalesce(theirs, F.lit("")) == "") | F.col(mine).eqNullSafe(F.col(theirs))

    ok = (
        (F.col("notification_status") == "success") & F.col("week_id").eqNullSafe(F.col("_week"))
        & (F.coalesce("doc_id", F.lit("")) != "") & (F.coalesce("doc_url", F.lit("")) != "")
        & agrees("doc_id", "_doc") & agrees("doc_url", "_url")
    )
    return out.withColumn("consistent", F.coalesce(ok, F.lit(False))).drop("_week", "_doc", "_url")


def week_filter(items: DataFrame, start: Column, end: Column) -> DataFrame:
    """Items published inside [start, end).

    A typed `pub_ts`, where the items have one, narrows the scan to the days around the window first; the exact rule on the
    published text decides.
    """
    if "pub_ts" in items.columns:
        near = (F.col("pub_ts") >= start - F.expr("INTERVAL 2 DAYS")) & (F.col("pub_ts") < end + F.expr("INTERVAL 2 DAYS"))
        items = items.filter(F.col("pub_ts").isNull() | near)
    return items.filter(in_window(F.col("pub_datetime"), F.col("publish_date"), start, end))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))


def _grams(text: Column, size: int) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) >= size, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(low) - (size - 1)), lambda i: F.substring(low, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>"))


SIEVE_WORDS = 1 << 20  # of 64 bits


def _sieve(tokens: DataFrame) -> Column:
    """One value of a fixed size (8 MB) with a bit for the hash of every row of (podcast_name, token); see `_sifted`."""
    place, bit = _bit_of(F.col("podcast_name"), F.col("token"))
    bits = tokens.groupBy(place.alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    words = tokens.sparkSession.range(SIEVE_WORDS).join(bits, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("word"))
    return words.agg(F.sort_array(F.collect_list("word")).alias("words")).select("words.bits").scalar()


def _sifted(rows: DataFrame, sieve: Column) -> DataFrame:
    """Rows of (podcast_name, token, ...) without most of those that the sieve was not made of; all others stay."""
    place, bit = _bit_of(F.col("podcast_name"), F.col("token"))
    return rows.where(F.call_function("shiftright", F.get(sieve, place.cast("int")), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1)


def _bit_of(feed: Column, token: Column) -> tuple[Column, Column]:
    code = F.xxhash64(feed, token)
    return F.pmod(F.shiftright(code, 6), F.lit(SIEVE_WORDS)), F.pmod(code, F.lit(64)).cast("int")


POINTS = {"d": 100, "w": 5, "h": 20, "l": 3}  # date, shared word, whole hint, first three letters


def best_match(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Best item per request within its feed.

    Points: 100 for the date, 5 per shared word, 20 if the hint occurs in the title, 3 if its first
    three characters do (hints of four or more). Ties go to the latest date, then the first item.

    Whatever gives points is a token: a date prefix, a word, a piece of the title as long as some hint of the feed, three
    letters. Tokens that only one side has are dropped, most of them in place by a sieve of what is asked, the others by a join;
    then items with the same tokens are one class, of which the
    tie rule leaves one item, and so are requests. A request class first meets the item classes that hold its rarest
    token, which settles it if the best of them beats all that its other tokens could give. The rest meet through so many of
    their rarest tokens that the others together give less than that best: whatever scores as much holds one of them. So
    frequent tokens of few points bring nothing together. Requests nothing scores for take the feed's latest item.
    """
    reqs = requests.select("request_id", "podcast_name", F.lower(F.coalesce("hint", F.lit(""))).alias("low"), F.coalesce("hint", F.lit("")).alias("hint"),
                           F.left(F.coalesce("publish_date", F.lit("")), F.lit(10)).alias("want"))
    its = items.select("podcast_name", "item_pos", F.coalesce("title", F.lit("")).alias("title"), "pub_date")

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(kind), v))

    wanted = F.concat(
        named("w", _words(F.col("hint"))), F.when(F.col("low") != "", F.array(F.concat(F.lit("h"), "low"))).otherwise(F.array().cast("array<string>")),
        F.when(F.length("low") >= 4, F.array(F.concat(F.lit("l"), F.left("low", F.lit(3))))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("want") != "", F.array(F.concat(F.lit("d"), "want"))).otherwise(F.array().cast("array<string>")))
    asked = reqs.select("request_id", "podcast_name", F.explode(wanted).alias("token"))
    wished = asked.select("podcast_name", "token").distinct()
    # Lengths of a feed's hints: at most as many as a title has characters matter.
    lengths = reqs.filter("low <> ''").groupBy("podcast_name").agg(F.collect_set(F.length("low")).alias("lengths"))
    dates = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda n: F.left("pub_date", n)))
    pieces = F.flatten(F.transform(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: _grams(F.col("title"), n)))
    offered = its.join(lengths, "podcast_name", "left").select("podcast_name", "item_pos", "pub_date", F.explode(F.array_distinct(F.concat(
        named("w", _words(F.col("title"))), named("h", pieces), named("l", _grams(F.col("title"), 3)), F.coalesce(named("d", dates), F.array().cast("array<string>"))))).alias("token"))
    offered = _sifted(offered, _sieve(wished)).join(wished, ["podcast_name", "token"], "left_semi")
    classes = offered.groupBy("podcast_name", "item_pos", "pub_date").agg(F.sort_array(F.collect_set("token")).alias("tokens")).groupBy("podcast_name", "tokens").agg(
        F.max(F.struct("pub_date", (-F.col("item_pos")).alias("back"))).alias("top"))
    classes = materialize(classes.withColumn("item_class", F.xxhash64("podcast_name", "tokens")), "match-items")
    by_token = classes.select("podcast_name", "item_class", "tokens", "top", F.explode("tokens").alias("token"))
    often = by_token.groupBy("podcast_name", "token").agg(F.count("*").alias("n"))

    points = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    known = asked.join(often, ["podcast_name", "token"]).groupBy("request_id", "podcast_name").agg(
        F.sort_array(F.collect_set(F.struct("n", "token", points[F.left("token", F.lit(1))].alias("points")))).alias("tokens"))
    known = materialize(known.withColumn("request_class", F.xxhash64("podcast_name", "tokens")), "match-requests")
    asking = known.select("request_class", "podcast_name", "tokens").dropDuplicates(["request_class"])

    mine, shared = F.col("mine"), F.aggregate(F.filter("mine", lambda t: F.array_contains("tokens", t["token"])), F.lit(0), lambda acc, t: acc + t["points"])

    def met(asks: DataFrame) -> DataFrame:
        best = asks.join(by_token, ["podcast_name", "token"]).select("request_class", "mine", F.struct(shared.alias("score"), "top").alias("best"))
        return best.groupBy("request_class").agg(F.max("best").alias("best"))

    asking = asking.select("request_class", "podcast_name", F.col("tokens").alias("mine"))
    first = materialize(met(asking.withColumn("token", F.get(mine, F.lit(0))["token"])), "match-first")
    # A token is needed while it and those after it could give as much as the best so far.
    needed = F.filter(mine, lambda t, i: (i > 0) & (F.aggregate(F.slice(mine, i + 1, F.size(mine)), F.lit(0), lambda acc, u: acc + u["points"]) >= F.col("best.score")))
    second = met(asking.join(first, "request_class").select("request_class", "podcast_name", "mine", F.explode(needed["token"]).alias("token")))
    best = first.unionByName(second).groupBy("request_class").agg(F.max("best").alias("best"))
    found = known.select("request_id", "request_class").join(best, "request_class").select(
        "request_id", "best.score", (-F.col("best.top.back")).alias("item_pos"))
    latest = its.groupBy("podcast_name").agg(F.max(F.struct("pub_date", (-F.col("item_pos")).alias("back"))).alias("top")).select("podcast_name", (-F.col("top.back")).alias("latest_pos"))
    out = reqs.select("request_id", "podcast_name").join(found, "request_id", "left").join(latest, "podcast_name", "left")
    return out.select("request_id", "podcast_name", F.coalesce("item_pos", "latest_pos").alias("item_pos"),
                      F.when(F.col("latest_pos").isNotNull(), F.coalesce("score", F.lit(0))).alias("score"))


def resolve_audio(requests: DataFrame, feeds: DataFrame, items: DataFrame) -> DataFrame:
    """Audio address per request, or the reason why there is none."""
    matched = best_match(requests, items)
    detail = items.select("podcast_name", "item_pos", "title", "pub_date", "enclosure_url")
    known = feeds.select("podcast_name", F.col("rss_url"), F.col("has_body"))
    out = matched.join(known, ["podcast_name"], "left").join(detail, ["podcast_name", "item_pos"], "left")
    error = (
        F.when(F.coalesce("rss_url", F.lit("")) == "", F.concat(F.lit("No RSS feed found for: "), F.col("podcast_name")))
        .when(~F.coalesce("has_body", F.lit(False)), F.concat(F.lit("Failed to fetch RSS: "), F.col("rss_url")))
        .when(F.col("item_pos").isNull(), F.lit("No episodes found in RSS feed"))
        .when(F.coalesce("enclosure_url", F.lit("")) == "", F.lit("No matching episode found"))
    )
    return out.select(
        "request_id", "podcast_name",
        *[F.when(error.isNull(), F.col(c)).otherwise("").alias(n) for c, n in (
            ("enclosure_url", "audio_url"), ("title", "title"), ("pub_date", "pub_date"))],
        F.when(error.isNull(), "rss_enclosure").otherwise("").alias("source"), F.coalesce(error, F.lit("")).alias("error"))


_FEW = 100_000  # aliases that are broadcast


def expand_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Short name to full name where the full name occurs in the item's text, else a longer form found there.

    Needs name, text. Names of one or two characters may also grow by what directly follows them. Their places in the
    text are marked first, so that the patterns are constant whatever the name holds.
    """
    table = aliases.select(F.col("short").alias("name"), F.col("full").alias("_full"))
    # A list that is short by its count goes to the texts: dealt by name, all texts of a frequent name would meet in one task.
    few = table.limit(_FEW + 1).count() <= _FEW
    out = names.join(F.broadcast(table) if few else table, "name", "left")
    listed = F.when(F.contains(F.lower("text"), F.lower("_full")), F.col("_full"))
    small = (F.length("name") >= 1) & (F.length("name") <= 2) & F.contains(F.col("text"), F.col("name"))
    marked = F.when(small, F.replace(F.replace("text", F.lit(_MARK), F.lit("")), F.col("name"), F.concat(F.lit(_MARK), "name")))

    def grown(size: int) -> Column:
        forms = F.regexp_extract_all(marked, F.lit(f"(?s){_MARK}.{{{size}}}(?:{_MARK}?[\\x{{4e00}}-\\x{{9fff}}]){{0,2}}(?:{_TITLES})?"), F.lit(0))
        plain = F.transform(forms, lambda f: F.replace(f, F.lit(_MARK), F.lit("")))
        return F.get(F.filter(plain, lambda f: (f != F.col("name")) & ~f.rlike("(?:会怎|认为|也是|多次)$")), F.lit(0))

    longer = F.when(F.length("name") == 1, grown(1)).otherwise(grown(2))
    short = F.length("name") <= 4
    return out.withColumn("resolved_name", F.when(short, F.coalesce(listed, longer, F.col("name"))).otherwise(F.col("name"))).drop("_full")


_MARK = "\x01"
_TITLES = "|".join(f"{_MARK}?{a}{_MARK}?{b}" for a, b in ("先生", "女士", "博士", "教授"))
