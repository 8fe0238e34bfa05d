"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``vnodes`` points on a ring of 64-bit hashes. A document's key is
the hash of its text, so equal texts stand together; it belongs to the first
point clockwise. A shard takes at most its share of the rows; what comes after
continues clockwise to the next shard with room, so no load exceeds its bound
and only overflowing keys leave their own arc.

How many rows of an arc go where follows from the row count of each arc alone: a
table of shards * vnodes numbers, whatever the corpus. The rows themselves are
numbered within their arc by Spark, a hot arc being dealt over many cells.

With ``slack`` 0 shares differ by one row at most (law ``rows``); with more,
loads may differ by that part and fewer keys move.

Defined results: null text has size 1 and the checksum of no bytes; rows equal
in id and text are interchangeable; an empty table gives an empty result; extra
columns are ignored. Only DataFrame functions touch rows.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import common as C
from tallymark.session import stage_table

SLOT_BITS = 9  # the ring's points are listed by their first nine bits


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""
    def place(shard: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"shard {shard} node {v}".encode()).digest()[:8], "big", signed=True)
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def arc_of(key: Column, points: list[tuple[int, int]]) -> Column:
    """Index of the first point at or after ``key``; past the last it is the first."""
    places = [p for p, _ in points]
    low, width = -(1 << 63), 1 << (64 - SLOT_BITS)
    slots = []
    for i in range(1 << SLOT_BITS):
        start = bisect_left(places, low + i * width)
        end = bisect_left(places, low + (i + 1) * width)
        own = ", ".join(f"{p}L" if p != low else "bigint('-9223372036854775808')" for p in places[start:end])
        slots.append(f"struct({start} AS start, cast(array({own}) AS array<bigint>) AS own)")
    slot = F.expr(f"array({', '.join(slots)})")[
        (F.shiftright(key, 64 - SLOT_BITS) + (1 << (SLOT_BITS - 1))).cast("int")]
    before = slot["start"] + F.size(F.filter(slot["own"], lambda p: p < key))
    return F.pmod(before, F.lit(len(points))).cast("int")


def spread(loads: dict[int, int], points: list[tuple[int, int]], shards: int,
           slack: float) -> list[tuple[int, int, int, int, int]]:
    """Stretches (arc, from, to, shard, first slot) that place every row of every arc.

    Arcs first fill their own shard; overflow then continues clockwise.
    """
    total = sum(loads.values())
    if slack > 0:
        room = [math.ceil((1 + slack) * total / shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    placed, used, out = dict.fromkeys(loads, 0), [0] * shards, []

    def put(arc: int, shard: int) -> None:
        n = min(loads[arc] - placed[arc], room[shard] - used[shard])
        if n > 0:
            out.append((arc, placed[arc], placed[arc] + n, shard, used[shard]))
            placed[arc] += n
            used[shard] += n

    for arc in sorted(loads):
        put(arc, points[arc][1])
    for arc in sorted(loads):
        for step in range(1, len(points)):
            if placed[arc] == loads[arc]:
                break
            put(arc, points[(arc + step) % len(points)][1])
    return out


def ring_shards(docs: DataFrame, shards: int = 8, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, the own shard, the shard and the slot of every row."""
    spark = docs.sparkSession
    points = ring_points(shards, vnodes)
    text = C.whole_text()
    keyed = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_key"))
    rows = stage_table(keyed.withColumn("_arc", arc_of(F.col("_key"), points)), "ring")
    loads = {r["_arc"]: r["count"] for r in rows.groupBy("_arc").count().collect()}
    stretches = spark.createDataFrame(
        spread(loads, points, shards, slack), "_arc int, _from long, _to long, shard int, _slot long")
    numbered = C.gapless_index(
        rows, "_arc", F.xxhash64("doc_id", "_key"),
        [F.col(c) for c in ("_key", "doc_id", "size", "text_crc32")], "_index", loads)
    owner = F.element_at(F.array(*[F.lit(s) for _, s in points]), F.col("_arc") + 1)
    return (numbered.join(F.broadcast(stretches), "_arc")
            .where("_index >= _from AND _index < _to")
            .select("doc_id", "size", "text_crc32", owner.alias("own_shard"), "shard",
                    (F.col("_slot") + F.col("_index") - F.col("_from")).alias("slot")))


def ring_shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents in shards 0 to 7, row counts at most one apart."""
    return ring_shards(C.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "own_shard")
