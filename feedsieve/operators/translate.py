"""Chunked translation of notes with a content-addressed cache table.

The user callable runs once per missing chunk in `mapInPandas`; everything around it (eligibility, cache
hits, chunking, completeness, status) is column work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsieve.functions.bind import let
from feedsieve.functions.boilerplate import filter_blocks
from feedsieve.functions.chunks import DISPLAY_CHUNK_CHARS, TRANSLATION_CHUNK_CHARS, pack_chunks, split_sections
from feedsieve.functions.items import cache_key, source_hash
from feedsieve.functions.language import (
    language_of, letter_counts, needs_translation_from, residual_latin, source_completeness)
from feedsieve.functions.links import RESOURCE_HEADING, append_missing_urls, append_urls, extract_urls, resource_fallback, untranslated_lines
from feedsieve.functions.text import best_display_text, clean_display_html
from feedsieve.session import materialize

# Fixed values.
MOCK_MODEL = "mock-show-notes-translator-v1"
MOCK_HEADING = "【中文翻译/mock】\n"
PLACEHOLDER = "暂无节目介绍。"
SNAPSHOT_VERSION = "show_notes_display_v1"
DISPLAYABLE = ("translated", "cache_hit", "partial_translated", "partial_cache_hit")
KEPT_LINES = 8


def mock_translate(chunk: str, target: str) -> str:
    return MOCK_HEADING + chunk


def chunk_table(docs: DataFrame, key: str, text: str, limit: int = TRANSLATION_CHUNK_CHARS) -> DataFrame:
    """One row per chunk: key, chunk_index, chunk."""
    return docs.select(key, F.posexplode(pack_chunks(F.col(text), limit)).alias("chunk_index", "chunk"))


def run_callable(chunks: DataFrame, translate: Callable[[str, str], str | None], target: str = "zh") -> DataFrame:
    """Call a translator once per chunk, in Arrow batches; a raised error becomes a column, never a job failure."""

    def once(chunk: str) -> tuple[str, str]:
        try:
            return translate(chunk, target) or "", ""
        except Exception as failure:
            return "", f"{type(failure).__name__}: {failure}"

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [once(c) for c in frame["chunk"]]
            yield frame.assign(raw=[p[0] for p in pairs], failure=[p[1] for p in pairs])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(batch, f"{fields}, raw string, failure string")


def judge_chunks(called: DataFrame, check_copied: bool = False) -> DataFrame:
    """Per chunk: shown text, whether it counts as translated, and its error if any."""
    full = called.withColumn("output", F.when(F.col("failure") == "", append_missing_urls(F.col("chunk"), F.col("raw"))).otherwise(""))
    copied = untranslated_lines(F.col("chunk"), F.col("output")) if check_copied else F.array().cast("array<string>")
    lined = full.withColumns({"copied": copied, "fallback": resource_fallback(F.col("chunk"))})
    empty = (F.col("failure") == "") & (F.col("output") == "")
    partial = (F.col("failure") == "") & ~empty & (F.size("copied") > 0)
    error_type = F.when(F.col("failure") != "", "exception").when(empty, "empty_translation").when(partial, "incomplete_translation")
    message = (F.when(F.col("failure") != "", F.col("failure")).when(empty, "translation runner returned empty text")
               .when(partial, "translation copied significant source lines unchanged"))
    localized = partial & (F.col("fallback") != "")
    return lined.withColumns({
        "error_type": error_type, "error": message, "localized": localized, "translated": error_type.isNull(),
        "unchanged_lines": F.slice("copied", 1, KEPT_LINES),
        "shown": F.when(error_type.isNull(), F.col("output")).when(localized, F.col("fallback")),
    }).drop("raw", "failure", "output", "fallback", "copied")


def document_status(total: Column, translated: Column, errors: Column, localized: Column) -> Column:
    return (F.when(total == 0, "skipped").when(errors == 0, "ok").when((translated > 0) & (localized > 0) & (localized == errors), "partial_ok")
            .when(translated > 0, "partial_failed").otherwise("failed"))


def roll_up(chunks: DataFrame, key: str) -> DataFrame:
    """Document result from its chunks (a document has at most text/limit of them)."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("chunk_index", "shown"))))
    errors = F.sort_array(F.collect_list(F.when(F.col("error_type").isNotNull(), F.struct(
        "chunk_index", "error_type", "error", F.col("localized").alias("localized_fallback"), "unchanged_lines"))))
    spots = F.sort_array(F.collect_list(F.when(F.col("localized"), F.col("chunk_index"))))
    out = chunks.groupBy(key).agg(
        F.count("*").alias("chunk_count"), F.count_if("translated").alias("translated_chunk_count"),
        F.array_join(ordered["shown"], "\n\n").alias("translated_text"), errors.alias("errors"), spots.alias("localized_fallback_chunk_indices"))
    return out.withColumn("status", document_status(
        F.col("chunk_count"), F.col("translated_chunk_count"), F.size("errors"), F.size("localized_fallback_chunk_indices")))


def translate_chunks(docs: DataFrame, key: str, text: str, translate: Callable = mock_translate, limit: int = TRANSLATION_CHUNK_CHARS,
                     attempts: int = 1, check_copied: bool = False) -> DataFrame:
    """Translate the texts of a table; one result row per document, documents without chunks are 'skipped'."""
    # Chunks are the unit of work: spread them so that one long document cannot hold up a task.
    todo = chunk_table(docs, key, text, limit).repartition(F.col(key), F.col("chunk_index"))
    columns = todo.columns
    judged, kept = judge_chunks(run_callable(todo, translate), check_copied), []
    for _ in range(1, max(1, int(attempts or 1))):
        # Stored before it is split: the callable must not run again for a chunk that is already done.
        judged = materialize(judged, "translated-chunks")
        again = F.coalesce(F.col("error_type").isin("empty_translation", "incomplete_translation"), F.lit(False))
        kept.append(judged.filter(~again))
        judged = judge_chunks(run_callable(judged.filter(again).select(*columns), translate), check_copied)
    for earlier in kept:
        judged = judged.unionByName(earlier)
    done = roll_up(judged, key)
    out = docs.select(key).join(done, key, "left")
    zero = F.lit(0).cast("bigint")
    return out.withColumns({
        "status": F.coalesce("status", F.lit("skipped")), "translated_text": F.coalesce("translated_text", F.lit("")),
        "chunk_count": F.coalesce("chunk_count", zero), "translated_chunk_count": F.coalesce("translated_chunk_count", zero)})


def valid_partial(entry: str = "") -> Column:
    """A partial cache entry whose counts, indices and errors agree."""
    c = lambda n: F.col(f"{entry}{n}")
    spots, errors = c("localized_fallback_chunk_indices"), c("errors")
    inside = F.forall(spots, lambda i: (i >= 0) & (i < c("chunk_count")))
    named = F.array_distinct(F.transform(errors, lambda e: e["chunk_index"]))
    good = (
        (c("status") == "partial_ok") & (c("translated_text") != "") & (c("chunk_count") > 0)
        & (c("translated_chunk_count") > 0) & (c("translated_chunk_count") < c("chunk_count"))
        & (F.size(spots) > 0) & inside & (F.size(F.array_distinct(spots)) == F.size(spots)) & (F.size(errors) > 0)
        & F.forall(errors, lambda e: F.coalesce(e["localized_fallback"], F.lit(False)))
        & (F.size(F.array_except(named, spots)) == 0) & (F.size(F.array_except(spots, named)) == 0)
        & F.contains(c("translated_text"), F.lit(RESOURCE_HEADING)))
    return F.coalesce(good, F.lit(False))


def with_translation_key(docs: DataFrame, text: str, model: str = MOCK_MODEL, keep_text: bool = False) -> DataFrame:
    """Detected language, need, source hash, addresses and cache key of each document; the text itself is dropped.

    Needs podcast_id, episode_id, episode_url, language. What follows joins and stores these narrow rows.
    """
    counted = docs.withColumn("_counts", letter_counts(F.col(text)))
    keyed = counted.withColumns({
        "detected_language": language_of(F.col("_counts")),
        "should_translate": needs_translation_from(F.col("_counts"), F.col("language")),
        "source_hash": source_hash(F.col(text)), "source_urls": extract_urls(F.col(text)),
    }).withColumn("cache_key", F.when(F.col("should_translate"), cache_key(
        F.col("podcast_id"), F.col("episode_id"), F.col("episode_url"), F.col(text), F.lit(model), hashed=F.col("source_hash")))).drop("_counts")
    return keyed if keep_text else keyed.drop(text)


def translation_cache_lookup(keyed: DataFrame, cache: DataFrame, text: str | None = None) -> DataFrame:
    """Cache view of each keyed document: hit, partial_hit or miss, with the cached text.

    With `text`, a cached translation that still holds lines of that source column does not count as a hit.
    """
    entry = cache.select("cache_key", *[F.col(c).alias(f"c_{c}") for c in (
        "status", "translated_text", "chunk_count", "translated_chunk_count", "localized_fallback_chunk_indices", "errors")])
    # Documents without a key match nothing; keyed by their content here, they spread over all tasks instead of one.
    spread = keyed.withColumn("_key", F.coalesce("cache_key", F.concat(F.lit("none "), "source_hash")))
    joined = spread.join(entry.withColumnRenamed("cache_key", "_key"), "_key", "left").drop("_key")
    shown = joined.withColumn("cached_text", F.when(F.col("c_translated_text").isNotNull(), append_urls(F.col("source_urls"), F.col("c_translated_text"))))
    whole = (F.col("c_status") == "ok") & (F.coalesce("c_translated_text", F.lit("")) != "")
    if text is not None:
        whole = whole & (F.size(untranslated_lines(F.col(text), F.col("cached_text"))) == 0)
    state = F.when(whole, "hit").when(valid_partial("c_"), "partial_hit").otherwise("miss")
    return shown.withColumn("cache_state", state)


def translation_cache_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Keyed documents whose key has no finished entry."""
    done = cache.filter((F.col("status") == "ok") & (F.col("translated_text") != "")).select("cache_key")
    # Stored narrow first: each key is worked out once, by whatever tasks hold the texts; a filter on it would run in the scan.
    return materialize(keyed, "translation-keys").filter(F.col("cache_key").isNotNull()).join(done, "cache_key", "left_anti")


def translate_with_cache(docs: DataFrame, cache: DataFrame, key: str, text: str, translate: Callable = mock_translate,
                         model: str = MOCK_MODEL, limit: int = TRANSLATION_CHUNK_CHARS, attempts: int = 1, check_copied: bool = False) -> DataFrame:
    """Eligibility, cache lookup, translation of the misses only; one status row per document."""
    keyed = with_translation_key(docs, text, model, keep_text=check_copied)
    # Stored narrow: the texts are not carried through the cache join, and are read again for the misses only.
    looked = materialize(translation_cache_lookup(keyed, cache, text if check_copied else None).drop(text), "cache-states")
    misses = looked.filter(F.col("should_translate") & (F.col("cache_state") == "miss")).select(key)
    wanted = docs.select(key, text).join(misses, key, "left_semi")
    fresh = translate_chunks(wanted, key, text, translate, limit, attempts, check_copied).select(
        key, *[F.col(c).alias(f"n_{c}") for c in ("status", "translated_text", "chunk_count", "translated_chunk_count", "errors",
                                                  "localized_fallback_chunk_indices")])
    out = looked.join(fresh, key, "left")
    renamed = (F.when(F.col("n_status") == "ok", "translated").when(F.col("n_status") == "partial_ok", "partial_translated")
               .otherwise(F.col("n_status")))
    hit = F.col("cache_state") == "hit"
    partial = F.col("cache_state") == "partial_hit"
    zero = F.lit(0).cast("bigint")

    def pick(cached: Column, new: str, otherwise: Column) -> Column:
        return F.when(~F.col("should_translate"), otherwise).when(hit | partial, cached).otherwise(F.coalesce(F.col(new), otherwise))

    status = (F.when(~F.col("should_translate"), "skipped").when(hit, "cache_hit").when(partial, "partial_cache_hit").otherwise(renamed))
    return out.select(
        key, status.alias("status"), pick(F.col("cached_text"), "n_translated_text", F.lit("")).alias("translated_text"),
        F.coalesce(F.nullif(F.lower(F.trim("language")), F.lit("")), "detected_language").alias("source_language"),
        "detected_language", "should_translate", (F.col("should_translate") & (hit | partial)).alias("cache_hit"),
        F.coalesce("cache_key", F.lit("")).alias("cache_key"), "source_hash",
        pick(F.coalesce("c_chunk_count", zero), "n_chunk_count", zero).alias("chunk_count"),
        pick(F.coalesce("c_translated_chunk_count", zero), "n_translated_chunk_count", zero).alias("translated_chunk_count"),
        F.lit(model).alias("model"), F.col("n_errors").alias("errors"), F.col("n_localized_fallback_chunk_indices").alias("localized_fallback_chunk_indices"))


def new_cache_entries(results: DataFrame) -> DataFrame:
    """Entries to publish after a run: fresh whole and partial translations."""
    fresh = results.filter(F.col("status").isin("translated", "partial_translated"))
    return fresh.select("cache_key", F.when(F.col("status") == "translated", "ok").otherwise("partial_ok").alias("status"),
                        "translated_text", "source_hash", "model", "chunk_count", "translated_chunk_count", "localized_fallback_chunk_indices", "errors")


def valid_snapshot(version: Column, heading: Column, sections: Column) -> Column:
    """Stored display sections if they are usable, else null."""
    kept = F.filter(F.coalesce(sections, F.array().cast("array<string>")), lambda s: F.trim(F.coalesce(s, F.lit(""))) != "")
    return let(kept, lambda k: F.when((version == SNAPSHOT_VERSION) & heading.isin("full", "translated") & (F.size(k) > 0), k))


def display_result(docs: DataFrame, key: str, translated: DataFrame | None = None, limit: int = DISPLAY_CHUNK_CHARS, diagnostics: bool = True) -> DataFrame:
    """Display sections and diagnostics per item; without `diagnostics` key, heading, sections and translation_status only.

    Needs show_notes_text, show_notes, description, summary_3_sentences_cn, one_line_summary_cn, language,
    show_notes_truncated, show_notes_source, show_notes_text_len. `translated` is a `translate_with_cache` result.
    """
    if translated is None:
        base = docs.withColumns({"t_status": F.lit("disabled"), "t_text": F.lit("")})
    else:
        base = docs.join(translated.select(key, F.col("status").alias("t_status"), F.col("translated_text").alias("t_text")), key, "left")
    usable = F.coalesce(F.col("t_status").isin(*DISPLAYABLE), F.lit(False))
    base = base.withColumn("t_clean", F.when(usable, clean_display_html(F.col("t_text"))).otherwise(""))
    is_translated = F.col("t_clean") != ""
    source = best_display_text(*[F.col(c) for c in (
        "show_notes_text", "show_notes", "description", "summary_3_sentences_cn", "one_line_summary_cn")])

    def shown(display_text: Column) -> list[Column]:
        original = let(split_sections(display_text, limit), lambda own: F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(PLACEHOLDER))))
        return [F.col(key), F.when(is_translated, "translated").otherwise("full").alias("heading"),
                F.when(is_translated, split_sections(F.col("t_clean"), limit, cleaned=True)).otherwise(original).alias("sections"),
                F.coalesce("t_status", F.lit("failed")).alias("translation_status")]

    if not diagnostics:
        # All in the branch that shows it: the own sections of a translated text, which nobody sees, are not worked out.
        return base.select(*shown(filter_blocks(source, cleaned=True)["text"]))
    base = base.withColumn("source_text", source)
    base = base.withColumn("_f", filter_blocks(F.col("source_text"), cleaned=True)).withColumn("display_text", F.col("_f.text"))
    base = base.withColumns({
        "_counts": letter_counts(F.col("display_text")),
        "completeness": source_completeness(F.col("source_text"), F.col("display_text"), F.col("show_notes_truncated"),
                                            F.col("show_notes_source"), F.col("show_notes_text_len"))})
    base = base.withColumns({
        "detected_language": language_of(F.col("_counts")), "should_translate": needs_translation_from(F.col("_counts"), F.col("language"))})
    return base.select(
        *shown(F.col("display_text")), "detected_language", "should_translate",
        F.col("_f.kept_category_counts").alias("kept_category_counts"), F.col("_f.removed_category_counts").alias("removed_category_counts"),
        F.col("_f.removed_reasons").alias("removed_reasons"), "completeness", residual_latin(F.col("t_clean")).alias("residual_latin"))
