"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsieve.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **names: str) -> DataFrame:
    """The named columns under fixed names; any other column, clashing or not, stays out."""
    return df.select(*[df[column].alias(name) for name, column in names.items()])


def row_key(*columns: str) -> Column:
    """Key of a row by content: rows that repeat share it, and so share their result."""
    return F.xxhash64(*columns)



def components(links: DataFrame, folder: str = "components") -> DataFrame:
    """(node, component) of every node in `links` (a, b): the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes. Minima are pre-aggregated, written and joined
    back as tables of their own, so adaptive execution can split the rows of a node with very many links; each step
    is a written table, so a lost executor costs no more than that step.
    """
    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/links")
    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")), f"{folder}/low")
        # Each larger neighbour of a node hangs below the smallest node that this one sees.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(large.where("a > b").distinct(), f"{folder}/links")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("low")), f"{folder}/low")
        # Each smaller neighbour, and the node itself, hang below the smallest of them.
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        links = materialize(small.where("a > b").distinct(), f"{folder}/links")
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
