"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsieve.session import materialize

SHARDS = 40
REPLICAS = 16  # virtual nodes of a shard
POSITIONS = 1 << 14  # places on the ring


def size_and_digest(text: Column) -> tuple[Column, Column]:
    """`size` (UTF-8 bytes and 16) and `text_crc32` of a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return (F.octet_length(whole) + 16).cast("bigint").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32")


def ring(shards: int, replicas: int = REPLICAS, positions: int = POSITIONS) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, in ring order. A shard's nodes do not depend on the other shards."""
    nodes = [(int.from_bytes(hashlib.md5(f"{s}/{r}".encode()).digest()[:8], "big") % positions, s) for s in range(shards) for r in range(replicas)]
    return sorted(nodes)


def placements(counts: dict[int, int], shards: int, replicas: int = REPLICAS, positions: int = POSITIONS) -> list[tuple[int, int, int, int, int]]:
    """(position, low, high, shard, first slot): which ranks of a position's rows go where.

    No shard's load exceeds the mean rounded up, and none stays below the mean rounded down. A position belongs to the
    next node clockwise. A shard keeps its own rows, in ring order, up to its bound; the others continue clockwise to
    the next node whose shard has room. Works on row counts of the ring's fixed positions, never on rows.
    """
    nodes = ring(shards, replicas, positions)
    at = [p for p, _ in nodes]
    own: list[list[tuple[int, int]]] = [[] for _ in nodes]
    demand = [0] * shards
    for position in sorted(counts):
        node = bisect_left(at, position) % len(nodes)
        own[node].append((position, counts[position]))
        demand[nodes[node][1]] += counts[position]
    total = sum(counts.values())
    low, rest = divmod(total, shards)
    room = [low] * shards
    for s in sorted(range(shards), key=lambda s: (-demand[s], s))[:rest]:
        room[s] += 1
    keep, filled, out = [min(d, r) for d, r in zip(demand, room)], [0] * shards, []
    spare = [r - k for r, k in zip(room, keep)]

    def put(position: int, first: int, last: int, shard: int) -> None:
        out.append((position, first, last, shard, filled[shard]))
        filled[shard] += last - first

    carried: deque[tuple[int, int, int]] = deque()
    for turn in range(2):
        for node, (_, shard) in enumerate(nodes):
            for position, n in own[node] if turn == 0 else ():
                stay = min(n, keep[shard])
                keep[shard] -= stay
                if stay:
                    put(position, 0, stay, shard)
                if n > stay:
                    carried.append((position, stay, n))
            while carried and spare[shard]:
                position, first, last = carried.popleft()
                take = min(last - first, spare[shard])
                spare[shard] -= take
                put(position, first, first + take, shard)
                if first + take < last:
                    carried.appendleft((position, first + take, last))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, replicas: int = REPLICAS, positions: int = POSITIONS) -> DataFrame:
    """Put every row of `docs` (doc_id, size, text_crc32) into a shard; law `rows`: counts are at most one apart.

    Returns doc_id, size, text_crc32, shard, slot and n: n of the rows with these values take the shard's places slot,
    slot + 1, ... (rows that agree in all may lie in two shards). Within a shard the places run from 0 without gaps. A row's
    place on the ring is a hash of all three columns, so null or repeated ids spread with their texts; rows that agree
    in all are counted together and placed side by side. Only the row counts of the ring's `positions` reach the
    driver, a number that does not grow with the data. Empty input: empty result.
    """
    spark = docs.sparkSession
    rows = docs.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    rows = materialize(rows.withColumn("hash", F.xxhash64("doc_id", "size", "text_crc32")).withColumn("position", F.pmod("hash", F.lit(positions)).cast("int")), "shard-rows")
    counts = {r["position"]: r["n"] for r in rows.groupBy("position").agg(F.sum("times").alias("n")).collect()}
    ranges = spark.createDataFrame(placements(counts, shards, replicas, positions), "position int, low long, high long, shard int, first long")
    order = Window.partitionBy("position").orderBy("hash", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("upto", F.sum("times").over(order)).withColumn("from", F.col("upto") - F.col("times"))
    # At most one range per position and two per node: bounded by the ring's size.
    placed = ranked.join(F.broadcast(ranges), "position").where("from < high AND upto > low")
    start = F.greatest("from", "low")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + start - F.col("low")).alias("slot"), (F.least("upto", "high") - start).alias("n"))


def every_slot(placed: DataFrame) -> DataFrame:
    """One row for each place of `shard`'s result."""
    return placed.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1))).drop("n")
