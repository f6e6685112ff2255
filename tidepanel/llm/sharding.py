"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns the arcs of the ring that end at its virtual nodes; a document lies where the hash of its
id and text puts it. Arcs are first served by their owners, up to a capacity a little above the mean load; what
overflows a full shard continues clockwise to the next shards with room. So balance is guaranteed, and
only overflow leaves its owner when loads or shards change.

Loads are summed per arc before the shuffle; the ring's plan is made on the driver from one row per arc,
whose number is the parameter ``virtual`` times ``shards`` and doesn't grow with the documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.lineage import cut

VIRTUAL = 512
SLACK = 0.002


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes in ring order, and their shards."""
    points = sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}", 7) - (1 << 63), s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points])


def serve(loads: dict[int, int], owners: np.ndarray, shards: int, slack: float = SLACK) -> dict[int, list[tuple[int, int, int]]]:
    """For each arc with a load: (from, to, shard) pieces of the load in ring order."""
    left = [-(-int(sum(loads.values()) * (1 + slack)) // shards) + 1] * shards
    plan: dict[int, list[tuple[int, int, int]]] = {}
    for arc in sorted(loads):
        shard = int(owners[arc])
        own = min(loads[arc], left[shard])
        left[shard] -= own
        plan[arc] = [(0, own, shard)] if own else []
    for arc in sorted(loads):
        at, node = plan[arc][-1][1] if plan[arc] else 0, arc
        while at < loads[arc]:
            node = (node + 1) % len(owners)
            shard = int(owners[node])
            if more := min(loads[arc] - at, left[shard]):
                left[shard] -= more
                plan[arc].append((at, at + more, shard))
                at += more
    return plan


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", virtual: int = VIRTUAL, slack: float = SLACK) -> DataFrame:
    """(``id_col``, ``size``, ``text_crc32``, ``shard``, ``slot``) for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1). Every shard's size is at most 1 + ``slack`` times
    the mean, give or take half a document. ``slot`` counts the shard's rows from 0 without gaps, in ring
    order. Null ids and texts, repeated rows and rows with equal texts are placed like any other; an
    empty table gives no rows; other columns are ignored.
    """
    points, owners = ring(shards, virtual)

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, position.to_numpy()) % len(points)).astype("int32")

    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(F.col(id_col), text).alias("position"))
    slim = cut(slim.withColumn("arc", arc_of("position")))
    loads = {r.arc: int(r.load) for r in slim.groupBy("arc").agg(F.sum("size").alias("load")).collect()}
    plan = serve(loads, owners, shards, slack)
    spark = docs.sparkSession
    pieces = spark.createDataFrame([(arc, [tuple(p) for p in ps]) for arc, ps in plan.items()], "arc int, pieces array<struct<lo: long, hi: long, shard: int>>")
    order = Window.partitionBy("arc").orderBy("position", "id", "crc")
    placed = slim.select("*", F.row_number().over(order).alias("nth"), (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) * 2 - F.col("size")).alias("middle"))
    placed = placed.join(F.broadcast(pieces), "arc")
    chosen = F.filter("pieces", lambda p: F.col("middle") <= p["hi"] * 2)[0]["shard"]
    placed = cut(placed.select("id", "size", "crc", "arc", "nth", F.coalesce(chosen, F.element_at("pieces", -1)["shard"]).alias("shard")))
    runs = placed.groupBy("shard", "arc").agg(F.count("*").alias("n"), F.min("nth").alias("first")).collect()
    base, so_far = [], [0] * shards
    for r in sorted(runs, key=lambda r: (r.arc, r.first)):
        base.append((r.shard, r.arc, so_far[r.shard] - r.first))
        so_far[r.shard] += r.n
    bases = spark.createDataFrame(base, "shard int, arc int, base long")
    out = placed.join(F.broadcast(bases), ["shard", "arc"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("nth")).alias("slot"))
