"""Whole texts are dealt to all tasks before they are worked on: a row group of a file is read by one task."""

import os

import pytest
from feedsieve.operators import translate
from feedsieve.plans import adapters, aggregate_queries, guest_queries, join_queries, text_queries
from pyspark.sql import functions as F

SF = os.environ.get("FEEDSIEVE_SF", "/root/testdata/sf0.001")


@pytest.fixture
def fixed(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def tasks(rows):
    return rows.select(F.spark_partition_id().alias("task")).distinct().count()


@pytest.mark.parametrize("rows", [
    adapters.texts, adapters.episodes, guest_queries.guest_items, join_queries.keyed_documents, text_queries.shown_items, text_queries.filter_blocks,
    aggregate_queries.filter_category_counts])
def test_texts_are_dealt_to_tasks(fixed, rows):
    assert tasks(rows(fixed, SF)) > 1


def test_filter_on_keys_does_not_work_on_texts(spark):
    cache = spark.createDataFrame([], "cache_key string, status string, translated_text string")
    plan = translate.translation_cache_misses(join_queries.keyed_documents(spark, SF), cache)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan


def test_texts_pass_by_the_candidates(spark):
    """Candidates that need their text again are held by key; texts are neither sorted nor broadcast."""
    plan = guest_queries.candidates(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [item_pos" in plan and "SortMergeJoin [item_pos" not in plan and "BroadcastHashJoin [item_pos" not in plan
