"""Registered queries against their SQL; all of them with FEEDSIEVE_ALL=1, else a quick selection."""

import os

import pytest

import __spark_entry__ as entry
import compare

SF = os.environ.get("FEEDSIEVE_SF", "/root/testdata/sf0.001")
QUICK = ("weekly_screen", "final_score", "classify_episode", "business_week", "week_filter", "keyword_hits", "dedup_cross_feed", "relative_priority", "weekly_limits", "top_recommendations",
         "translation_summary", "join_registry", "best_match", "selection_in_window", "pack_chunks", "split_sections", "translate_chunks", "scan_feed_items", "render_report", "render_subtitles",
         "guest_status", "search_result_rows", "stream_registry", "guest_prompt", "selection_doc_blocks", "union_feeds", "rank_by_score", "detect_language")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FEEDSIEVE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return compare.engine(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert ok, note


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() > 0
