"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Each shard has ``replicas`` points on a ring of 64-bit hashes; a key belongs to the first point clockwise
of its hash. A shard takes rows up to its capacity; rows that overflow continue clockwise to the next
points, nearest first. With ``slack`` zero the capacities are the counts of an even split, so
every shard ends full and counts differ by one at most. With more slack fewer rows leave their own shard.

What decides the overflow is one count per arc between neighbouring points: shards x replicas numbers, whatever
the size of the table. The plan of overflows is drawn up from them; rows then find their place by their rank in
their arc.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfare.llm.common import SALTS, class_ranks, stored

SLOT_BITS = 12


@dataclass(frozen=True)
class Ring:
    """Points in ascending hash order, with the shard of each."""

    hashes: tuple[int, ...]
    owners: tuple[int, ...]


def build_ring(spark: SparkSession, shards: int, replicas: int) -> Ring:
    points = spark.range(shards * replicas).select(
        F.xxhash64(F.concat_ws("/", F.lit("point"), F.floor(F.col("id") / replicas).cast("int"), F.col("id") % replicas)).alias("h"),
        F.floor(F.col("id") / replicas).cast("int").alias("shard"),
    )
    found = sorted((r["h"], r["shard"]) for r in points.collect())  # shards x replicas rows
    return Ring(tuple(h for h, _ in found), tuple(s for _, s in found))


def slot_table(spark: SparkSession, ring: Ring) -> DataFrame:
    """For each of 4,096 equal slots of the hash range: its points, and the arc that follows the last of them."""
    rows = []
    for slot in range(-(1 << (SLOT_BITS - 1)), 1 << (SLOT_BITS - 1)):
        low, high = slot << (64 - SLOT_BITS), (slot + 1) << (64 - SLOT_BITS)
        first, last = bisect_left(ring.hashes, low), bisect_left(ring.hashes, high)
        rows.append((slot, [(ring.hashes[i], i) for i in range(first, last)], last % len(ring.hashes)))
    return spark.createDataFrame(rows, "slot bigint, points array<struct<h:bigint,arc:int>>, after int")


def with_arc(df: DataFrame, ring: Ring, hashed: Column) -> DataFrame:
    """Add ``arc``, the number of the first point at or after the hash."""
    keyed = df.withColumn("__h", hashed).withColumn("slot", F.shiftright("__h", 64 - SLOT_BITS))
    slots = F.broadcast(slot_table(df.sparkSession, ring))  # 4,096 rows and shards x replicas points
    inside = F.get(F.filter("points", lambda p: p["h"] >= F.col("__h")), F.lit(0))["arc"]
    return keyed.join(slots, "slot").select(*df.columns, F.coalesce(inside, F.col("after")).alias("arc"))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil((1 + slack) * rows / shards)] * shards


def overflow_plan(ring: Ring, counts: dict[int, int], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the rows of each arc go, in rank order.

    In round r every arc with rows left asks the r-th point after it. A shard accepts until it is full, so rows
    stay as near to their own point as the loads allow.
    """
    points = len(ring.owners)
    free = list(limits)
    used = [0] * len(limits)
    left = [counts.get(a, 0) for a in range(points)]
    placed = [0] * points
    plan = []
    open_arcs = [a for a in range(points) if left[a]]
    for step in range(points):
        if not open_arcs:
            break
        for arc in open_arcs:
            shard = ring.owners[(arc + step) % points]
            take = min(left[arc], free[shard])
            if take:
                plan.append((arc, placed[arc], placed[arc] + take, shard, used[shard]))
                placed[arc] += take
                left[arc] -= take
                free[shard] -= take
                used[shard] += take
        open_arcs = [a for a in open_arcs if left[a]]
    if open_arcs:
        raise ValueError("capacities are smaller than the table")
    return plan


def plan_table(spark: SparkSession, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    for arc, *rest in plan:
        parts.setdefault(arc, []).append(tuple(rest))
    return spark.createDataFrame(
        list(parts.items()), "arc int, parts array<struct<first:bigint,end:bigint,shard:int,base:bigint>>"
    )


def ring_shards(
    df: DataFrame, key: str, shards: int = 24, replicas: int = 128, slack: float = 0.0, purpose: str = "ring"
) -> DataFrame:
    """The rows of ``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    Any key type is hashed, null included, and repeated rows are rows like any other: each gets a slot of its
    own. An empty table gives an empty result. ``df`` is written once to the shared folder, so keep only the
    columns that are needed. Columns named arc or __salt must not be among them.
    """
    spark = df.sparkSession
    ring = build_ring(spark, shards, replicas)
    on_arc = with_arc(df, ring, F.xxhash64(key))
    # salted by position in the input: a stored column, so that later reads see the same value
    rows = stored(on_arc.withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int")), purpose)
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per arc
    plan = overflow_plan(ring, counts, capacities(sum(counts.values()), shards, slack))
    ranked = class_ranks(rows, ["arc"], "__salt", [F.col(c) for c in df.columns], "__rank")
    places = F.broadcast(plan_table(spark, plan))  # at most a few rows per point of the ring
    mine = F.get(F.filter("parts", lambda p: (p["first"] <= F.col("__rank")) & (F.col("__rank") < p["end"])), F.lit(0))
    out = ranked.join(places, "arc").withColumn("__p", mine)
    return out.select(*df.columns, F.col("__p.shard").alias("shard"), (F.col("__rank") - F.col("__p.first") + F.col("__p.base")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``size`` (UTF-8 bytes of the text and 8; a null text has none), ``text_crc32``, ``law`` (rows: counts
    at most one apart), ``shard``, ``slot`` and ``grown_shard`` (null: overflow depends on all rows)."""
    octets = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(octets) + 8).cast("long").alias("size"), F.crc32(octets).alias("text_crc32"))
    out = ring_shards(rows, "doc_id", shards)
    return out.select(
        F.col("doc_id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
