"""From raw documents to shards: classify, drop near duplicates, decontaminate, mix, shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsieve.llm import benchmark, jaccard, mixing, quality, sharding
from feedsieve.llm.common import fresh_name, row_key, table
from feedsieve.session import materialize, prepare


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; those without words are rejected."""
    prepare(spark)
    return quality.classify(docs).where("kept").select("doc.*")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One of the rows that agree in all columns."""
    key = fresh_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    if keyed.groupBy(key).count().where("count > 1").isEmpty():
        return docs
    return keyed.dropDuplicates([key]).drop(key)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id.

    Rows that repeat stay once. Rows that share a doc_id but not their text are documents of their own; of those in one
    group one stays. Null ids and empty texts are in no group and stay.
    """
    prepare(spark)
    key = fresh_name(docs, "row")
    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", row_key("doc_id", "text").alias(key), "text")
    if keyed.groupBy("doc_id").agg(F.min(key).alias("least"), F.max(key).alias("most")).where("least < most").isEmpty():
        groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
        dropped = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-dropped")
        return one_of_each(docs.join(dropped, "doc_id", "left_anti").select(docs.columns))
    groups = jaccard.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id").distinct()
    members = materialize(groups.join(keyed.select(key, "doc_id").distinct(), key), "pipeline-members")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("first"))
    dropped = materialize(members.join(first, "component_id").where(F.col(key) != F.col(f"first.{key}")).select(key), "pipeline-dropped")
    full = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), row_key("doc_id", "text")))
    return one_of_each(full.join(dropped, key, "left_anti").select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is similar to a benchmark item."""
    prepare(spark)
    found = benchmark.contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    key = fresh_name(docs, "row")
    leaks = materialize(found.select(F.col("row").alias(key)).distinct(), "pipeline-leaks")
    return docs.withColumn(key, row_key("doc_id", "text")).join(leaks, key, "left_anti").drop(key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once, or up to three times."""
    prepare(spark)
    key, times = fresh_name(docs, "key"), fresh_name(docs, "times")
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    taken = mixing.mix(keyed.select(keyed[key].alias("doc_id"), keyed["source"].alias("source"), mixing.words_in(keyed["text"]).alias("size")))
    counts = taken.groupBy("doc_id").agg(F.sum("copies").alias(times), F.count("*").alias("rows")).where(F.col(times) > 0)
    counts = materialize(counts.withColumnRenamed("doc_id", key), "pipeline-taken")
    if not counts.where("rows > 1").isEmpty():
        keyed = keyed.dropDuplicates([key])
    full = keyed.join(counts.drop("rows"), key)
    return full.withColumn(times, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their place in it (columns `shard` and `slot`, renamed if docs has such)."""
    prepare(spark)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.xxhash64(*docs.columns).alias("row"))
    placed = sharding.shard(rows.select(F.col("row").alias("doc_id"), *sharding.size_and_digest(F.col("doc.text"))))
    placed = materialize(placed.select(F.col("doc_id").alias("row"), "shard", "slot", "n"), "pipeline-shards")
    # Rows that agree in all columns share a key: each takes one of that key's places.
    full = sharding.every_slot(rows.dropDuplicates(["row"]).join(placed, "row"))
    return full.select("doc.*", F.col("shard").alias(fresh_name(docs, "shard")), F.col("slot").alias(fresh_name(docs, "slot")))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

# The classifier's training and the parity sketches have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
