"""The composed weekly screening job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsieve.functions import score
from feedsieve.functions.items import episode_id
from feedsieve.operators import documents, guests, ranking, translate
from feedsieve.operators.background import enrich_guests
from feedsieve.operators.joins import join_registry, upsert_registry
from feedsieve.operators.quality import QUOTED, quality_warnings, reason_text, uncertainty_text, with_quote
from feedsieve.policy import Policy
from feedsieve.session import materialize
from feedsieve.sources import runs

# Long texts and helpers that end with the scoring pass.
TEXT_COLUMNS = ("show_notes", "show_notes_raw", "_title", "_notes", "_low", "_hits")


def decide(items: DataFrame, policy: Policy, quoted: bool = False) -> DataFrame:
    """Ids, scores and decisions of every item in one narrow pass; the texts stay behind, but for what a reason quotes if `quoted`.

    Needs podcast_id, publish_date, episode_title, show_notes, audio_url, duration_seconds, duration_minutes.
    """
    named = items.withColumn("episode_id", episode_id(F.col("podcast_id"), F.col("publish_date"), F.col("episode_title")))
    scored = score.add_scores(named, policy)
    if quoted:
        scored = with_quote(scored, policy)
    texts = [c for c in TEXT_COLUMNS if not (quoted and c in QUOTED)]
    extra = {
        "full_suggestion": score.full_suggestion(*[F.col(c) for c in ("final_score", "transcription_value", "topic_relevance", "strategic_value", "actionability")], policy),
        "uncertainty_zh": uncertainty_text(F.length("_notes"), F.col("novelty"), F.col("information_density"), F.col("score_decision")),
    }
    if policy.mode == "all_preview":
        extra["_v"] = score.classify(F.col("episode_title"), F.col("_notes"), F.col("audio_url"), F.col("duration_seconds"), F.col("duration_minutes"), policy)
        kept = scored.withColumns(extra)
        return kept.select(*[c for c in kept.columns if c not in (*texts, "_v")], F.col("_v.decision").alias("decision"),
                           F.col("_v.reason_code").alias("decision_reason_code"), F.col("_v.reason_zh").alias("decision_reason_zh"))
    extra |= {"decision": F.col("score_decision"), "decision_reason_code": F.concat(F.lit("score_based_"), "score_decision")}
    return scored.withColumns(extra).drop(*texts)


def screen(items: DataFrame, policy: Policy) -> DataFrame:
    """Score, classify, deduplicate and prioritise items of any number of weeks.

    The texts are read once and never shuffled: duplicates are found among the scored, narrow rows.
    """
    return settle(decide(items, policy), policy)


def settle(scored: DataFrame, policy: Policy) -> DataFrame:
    """Rows of `decide` without duplicates and with their priority.

    What is left is stored once, because the priority reads it twice (histogram, then rows).
    """
    unique = ranking.dedup_cross_feed(ranking.dedup_episode_id(scored))
    stored = materialize(unique, "decisions")
    if policy.mode == "all_preview":
        return ranking.relative_priority(stored)
    limited = ranking.weekly_limits(stored.withColumn("reason", F.lit("")), policy)
    return limited.withColumn("priority", ranking.fixed_priority(F.col("final_score")))


def weekly_top(items: DataFrame, policy: Policy, k: int = 3) -> DataFrame:
    """Best previews of every week with their priority."""
    narrow = screen(items, policy).select("week_id", "podcast_id", "item_pos", "feed_ord", "episode_id", "final_score", "decision",
                                          "decision_reason_code", "full_suggestion", "priority")
    return ranking.top_recommendations(narrow, k=k)


REGISTRY = ("episode_id string, podcast_id string, episode_title string, first_seen string, first_seen_week_id string, last_seen string, seen_count int, decision string, "
            "statuses array<string>")


def decision_records(items: DataFrame, policy: Policy, registry: DataFrame, hosts: DataFrame, run_at: str, cache: DataFrame | None = None, found: DataFrame | None = None, keep: int = 52) -> DataFrame:
    """One record per screened item: scores, decision, priority, reason, warnings, guests and their background, registry status.

    `items` as for `screen`, with podcast_name, pub_datetime, feed_ord, item_pos and week_id. `registry`: REGISTRY, as the last
    run left it. `cache` and `found` as for `enrich_guests`. Texts are read again only for the items that stay,
    and only for their guests: what a reason quotes is noted with the scores.
    """
    scored = materialize(decide(items, policy, quoted=True), "week-scores")
    decided = materialize(settle(scored.drop(*QUOTED), policy), "week-decisions")
    ids = decided.select("item_pos")
    kept = items.join(ids, "item_pos", "left_semi")
    # The few matches are sifted, not the texts: those would be sorted for a join, which costs more than to search the duplicates too.
    candidates = guests.dedup_candidates(guests.guest_candidates(items, hosts).join(ids, "item_pos", "left_semi"))
    detected = materialize(guests.guest_status(kept, candidates, hosts), "week-guests")
    if cache is None:
        payload = "struct<background_zh:string,sources:array<struct<title:string,url:string,snippet:string,quality:string>>,confidence:string,note:string>"
        cache = items.sparkSession.createDataFrame([], f"key string, cached_at timestamp, detection_status string, payload {payload}")
    told = enrich_guests(kept, detected, cache, found, F.lit(run_at).cast("timestamp")).drop("podcast_name", "guest_detection_status", "guest_names")
    judged = decided.select("item_pos", *[name for name, _ in score.WEIGHTS], "score_decision")
    judged = judged.join(detected.select("item_pos", "guest_names", "guest_detection_status", "guest_detection_evidence"), "item_pos")
    quoted = scored.select("item_pos", "podcast_name", "pub_datetime", "duration_minutes", *QUOTED).join(judged, "item_pos")
    explained = reason_text(quoted, policy).select(
        "item_pos", "reason_zh", "guest_names", "guest_detection_status", "guest_detection_evidence",
        quality_warnings(F.col("reason_zh"), None, F.col("pub_datetime"), F.col("duration_minutes"), size=F.col("_size")).alias("quality_warnings"))
    out = decided.join(explained, "item_pos").join(told, "item_pos", "left")
    if "decision_reason_zh" not in out.columns:
        out = out.withColumn("decision_reason_zh", F.col("reason_zh"))
    # The registry notes the first decision, and the final one too where the weekly limit changed it.
    final = F.col("decision")
    first = final if policy.mode == "all_preview" else F.col("score_decision")
    noted = join_registry(out.withColumns({"final_decision": final, "decision": first}), registry, run_at, F.col("week_id"), keep)
    both = F.concat("statuses", F.array("final_decision"))
    changed = F.slice(both, F.greatest(F.size(both) - (keep - 1), F.lit(1)), F.lit(keep))
    return noted.withColumns({
        "statuses": F.when(F.col("decision") != F.col("final_decision"), changed).otherwise(F.col("statuses")), "decision": F.col("final_decision"),
        "selection_policy_mode": F.lit(policy.mode)}).drop("final_decision")


def run_summary(records: DataFrame, run_at: str, errors: int = 0) -> DataFrame:
    """One row per run with what its report's head shows. Needs week_start."""
    shape = "yyyy-MM-dd'T'HH:mm:ssXXX"
    # Pairs of run and feed first: a distinct count would bring a run's rows together.
    feeds = records.groupBy("run_id", F.coalesce(F.nullif("podcast_id", F.lit("")), "podcast_name").alias("feed")).agg(F.lit(1).alias("one")).where("feed <> ''")
    counts = records.groupBy("run_id", "week_id").agg(F.min("week_start").alias("at"), F.count("*").alias("total"), *[F.count_if(F.col("decision") == d).alias(d) for d in runs.BUCKETS])
    return counts.join(feeds.groupBy("run_id").agg(F.count("*").alias("podcast_count")), "run_id", "left").select(
        "run_id", "week_id", F.date_format("at", shape).alias("window_start"), F.date_format(F.col("at") + F.expr("INTERVAL 7 DAYS"), shape).alias("window_end"),
        F.lit(run_at).alias("scan_date"), "total", *runs.BUCKETS, F.coalesce("podcast_count", F.lit(0)).alias("podcast_count"), F.lit(errors).cast("bigint").alias("error_count"))


CACHE = ("cache_key string, status string, translated_text string, source_hash string, model string, chunk_count bigint, translated_chunk_count bigint, "
         "localized_fallback_chunk_indices array<int>, errors array<struct<chunk_index:int,error_type:string,error:string,localized_fallback:boolean,unchanged_lines:array<string>>>")


def display(items: DataFrame, records: DataFrame, root: str, translator: Callable | None = None) -> DataFrame:
    """Display sections of every record (item_pos, heading, sections, translation_status), translated where `translator` is given.

    Only items that are not skipped are translated, and only what the cache below `root` lacks; finished texts join the
    cache, so a run that is repeated finds them there.
    """
    spark = items.sparkSession
    texts = items.join(records.select("item_pos", "episode_id", "decision"), "item_pos").withColumn("episode_url", F.coalesce("audio_url", F.lit("")))
    translated = None
    if translator is not None:
        path = f"{root}/translations"
        runs.write_cache_entries(spark.createDataFrame([], CACHE), path)  # so that there is a table to read
        cache = spark.read.schema(CACHE).parquet(path).dropDuplicates(["cache_key"])
        wanted = texts.where("decision <> 'skip'").select("item_pos", "podcast_id", "episode_id", "episode_url", "language", "show_notes")
        translated = materialize(translate.translate_with_cache(wanted, cache, "item_pos", "show_notes", translator), "week-translations")
        runs.write_cache_entries(translate.new_cache_entries(translated).dropDuplicates(["cache_key"]), path)
    text, none = F.col("show_notes"), F.lit(None).cast("string")
    ready = texts.select("item_pos", "language", text.alias("show_notes_text"), text.alias("show_notes"), none.alias("description"), F.array().cast("array<string>").alias("summary_3_sentences_cn"),
                         none.alias("one_line_summary_cn"), F.lit(False).alias("show_notes_truncated"), F.lit("show_notes").alias("show_notes_source"), F.length(text).alias("show_notes_text_len"))
    return translate.display_result(ready, "item_pos", translated, diagnostics=False)


def report(records: DataFrame, shown: DataFrame, summary: DataFrame) -> DataFrame:
    """Numbered report lines (week_id, run_id, line_no, line) of stored records with their display sections."""
    empty = F.lit(None).cast("string")
    lines = records.join(shown, "item_pos", "left").withColumns({
        "one_line_summary_cn": empty, "summary_3_sentences_cn": F.array().cast("array<string>"), "key_points_cn": F.array().cast("array<string>"),
        "sections": F.coalesce("sections", F.array().cast("array<string>")), "heading": F.coalesce("heading", F.lit("full"))})
    return documents.render_report(lines, summary).join(summary.select("run_id", "week_id"), "run_id").select("week_id", "run_id", "line_no", "line")


def run_week(items: DataFrame, policy: Policy, hosts: DataFrame, root: str, run_at: str, translator: Callable | None = None, with_report: bool = True, **more) -> DataFrame:
    """Screen, explain, look up and store a run below `root`; returns its records.

    Tables: `runs` (records by week and run), `registry` (versions), `log` (one row per run), `report` (numbered lines; unless
    `with_report` is off), and `translations` where a translator is given.

    The run is named by `run_at`, and its commit of the registry is what decides: a run that comes second, of two at once, starts
    again from the new registry. All else is written after it and replaces what it names. So a run that is repeated, after
    whatever failure, starts from the registry as it was before the run and leaves the same tables: no item is counted twice,
    no log row is written twice.
    """
    spark = items.sparkSession
    # Every step reads the texts: stored once, they are not built and dealt to the tasks again for each.
    items = materialize(items, "week-items")
    state = f"{root}/registry"
    fields = [f.split()[0] for f in REGISTRY.split(", ")]
    while True:
        done = runs.version_of(spark, state, run_at)
        base = done - 1 if done else runs.current_version(spark, state) or 0
        registry = runs.read_version(spark, state, REGISTRY, base)
        records = materialize(decision_records(items, policy, registry, hosts, run_at, **more), "week-records")
        if done:
            break
        try:
            runs.write_version(upsert_registry(registry, records.select(*fields)), state, base + 1, run_at)
            break
        except runs.VersionConflict:
            continue
    runs.write_run_result(records, f"{root}/runs")
    runs.replace_rows(runs.run_log_rows(records), f"{root}/log", ["week_id", "run_id"])
    if not with_report:
        return records
    shown = materialize(display(items, records, root, translator), "week-display")
    runs.replace_rows(report(records, shown, run_summary(records, run_at)), f"{root}/report", ["week_id", "run_id"])
    return records
