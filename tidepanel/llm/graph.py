"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

A shard's vectors enter its graph in batches: a greedy beam search over the graph so far proposes
neighbours, robust pruning keeps the diverse ones (a candidate goes if a kept neighbour, with the factor
``ALPHA``, is closer to it than the new vector is), and reverse edges are pruned alike. A query is searched in
every shard by beam search, and the best of all shards are merged by the inner product of the original
vectors in double precision. Queries travel to the shards: a task holds one graph and streams the queries past it.
Only while there are fewer shards than cores a graph has copies, each for a part of the queries.

Largest inner product is least distance once each vector has one more coordinate that brings all to the
same norm. Equal vectors are one vertex that lists its smallest ids, as many as a result can hold.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.lineage import written
from tidepanel.llm.vectors import matrix, usable

DEGREE = 32
BEAM = 96
ALPHA = 1.2
SHARDS = 6  # at least
SHARD = 1 << 14  # distinct vectors at most, about: recall at 20 with BEAM falls from 0.99 on 8,500 to 0.89 on 51,000
QUERIES = 512  # searched at once
BUILD_BEAM = 64
K = 20
_SALTS = (64, 8, 1)


def lift(x: np.ndarray) -> np.ndarray:
    """float32 rows with one more coordinate, so that all have the largest row's norm."""
    x = x.astype(np.float64)
    squares = np.einsum("ij,ij->i", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int = BEAM, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances (nearest first, -1 and inf where there are fewer) of each query's beam."""
    b, n = len(queries), len(x)
    squares = np.einsum("ij,ij->i", x, x)
    ids = np.full((b, beam), -1, dtype=np.int64)
    far = np.full((b, beam), np.inf, dtype=np.float32)
    opened = np.ones((b, beam), dtype=bool)
    seen = np.zeros((b, n + 1), dtype=bool)
    seen[:, n] = True
    ids[:, 0], opened[:, 0] = start, False
    far[:, 0] = squares[start] - 2 * (queries @ x[start])
    seen[:, start] = True
    live = np.arange(b)
    while len(live):
        rank = np.where(opened[live], np.inf, far[live])
        pick = np.argpartition(rank, width, axis=1)[:, :width] if beam > width else np.argsort(rank, axis=1)
        valid = np.isfinite(np.take_along_axis(rank, pick, axis=1))
        going = valid.any(axis=1)
        live, pick, valid = live[going], pick[going], valid[going]
        if not len(live):
            break
        opened[live[:, None], pick] = True
        nodes = np.where(valid, ids[live[:, None], pick], -1)
        near = np.where((nodes >= 0)[:, :, None], graph[nodes], -1).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        r, c = np.nonzero(fresh)
        to = near[r, c]
        d = np.full(near.shape, np.inf, dtype=np.float32)
        d[r, c] = squares[to] - 2 * np.einsum("ij,ij->i", queries[live[r]], x[to])
        all_d = np.concatenate([far[live], d], axis=1)
        all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_o = np.concatenate([opened[live], ~fresh], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        far[live] = np.take_along_axis(all_d, best, axis=1)
        ids[live] = np.take_along_axis(all_i, best, axis=1)
        opened[live] = np.take_along_axis(all_o, best, axis=1)
    order = np.lexsort((ids, far), axis=1)
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each point, up to ``degree`` neighbours (-1: none) out of its row of ``pool`` (-1: none, repeats allowed)."""
    pool = np.sort(np.where(pool == points[:, None], -1, pool), axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    v = x[pool]
    own = ((v - x[points][:, None, :]) ** 2).sum(2)
    own[pool < 0] = np.inf
    squares = np.einsum("ij,ij->i", x, x)[pool]
    between = squares[:, :, None] + squares[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1, dtype=np.int32)
    alive, rows = own.copy(), np.arange(len(points))
    for k in range(degree):
        best = alive.argmin(axis=1)
        ok = np.isfinite(alive[rows, best])
        if not ok.any():
            break
        out[ok, k] = pool[rows, best][ok]
        alive[alpha * alpha * between[rows, best] <= own] = np.inf
        alive[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """The graph (rows of neighbours, -1: none) over the rows of ``x`` and its entry."""
    n = len(x)
    slack = degree + degree // 2
    graph = np.full((n, slack), -1, dtype=np.int32)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at : at + max(1, min(256, at // 4))]
        at += len(batch)
        pool, _ = beam_search(x, graph, start, x[batch], beam)
        fellows = np.broadcast_to(batch[:32], (len(batch), min(32, len(batch))))
        kept = robust_prune(x, batch, np.concatenate([pool, fellows], axis=1), degree, alpha)
        graph[batch, :degree] = kept
        r, c = np.nonzero(kept >= 0)
        to, back = kept[r, c].astype(np.int64), batch[r]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        nodes, first, many = np.unique(to, return_index=True, return_counts=True)
        have = (graph[nodes] >= 0).sum(1)
        fits = have + many <= slack
        nth = np.arange(len(to)) - np.repeat(first, many)
        easy = np.repeat(fits, many)
        graph[to[easy], (np.repeat(have, many) + nth)[easy]] = back[easy]
        full = np.flatnonzero(~fits)
        if len(full):
            extra = np.full((len(full), int(many[full].max())), -1, dtype=np.int64)
            hard = ~easy
            extra[np.repeat(np.arange(len(full)), many[full]), nth[hard]] = back[hard]
            wide = robust_prune(x, nodes[full], np.concatenate([graph[nodes[full]].astype(np.int64), extra], axis=1), degree, alpha)
            graph[nodes[full]] = -1
            graph[nodes[full], :degree] = wide
    return graph, start


def _smallest(rows: DataFrame, most: int) -> DataFrame:
    """(``h``, ``ids``): the ``most`` smallest ids of each vector, in levels of ever fewer salts, so no copy count makes a large group."""
    for salts in _SALTS:
        salt = F.pmod(F.xxhash64("vec"), F.lit(salts))
        w = Window.partitionBy("h", salt).orderBy(F.col("vec").asc_nulls_last())
        rows = rows.withColumn("nth", F.row_number().over(w)).where(f"nth <= {most}").drop("nth")
    return rows.groupBy("h").agg(F.array_sort(F.collect_list("vec")).alias("ids"))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def index(vectors: DataFrame, most: int = K + 1) -> DataFrame:
    """(``shard``, ``blob``): the graphs of all shards; ``vectors`` has (``vec``, ``v``, ``h``), all usable.

    A shard is one task's work and holds about ``SHARD`` distinct vectors of one length at most.
    """
    distinct = vectors.dropDuplicates(["h"]).select("h", "v").join(_smallest(vectors.select("h", "vec").distinct(), most), "h")
    distinct = written(distinct)
    shards = max(SHARDS, -(-distinct.count() // SHARD))

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        column = table.column("v").combine_chunks()
        x = matrix(column)
        graph, start = build(lift(x))
        ids = table.column("ids").combine_chunks()
        blob = _pack(x=x, graph=graph, start=np.array(start), ids=ids.flatten().to_numpy(), bounds=np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]))
        return pa.table({"shard": table.column("shard").slice(0, 1), "blob": pa.array([blob], pa.binary())})

    keyed = distinct.withColumn("shard", F.size("v") * F.lit(1 << 32) + F.pmod("h", F.lit(shards)))
    return written(keyed.groupBy("shard").applyInArrow(make, "shard long, blob binary")).withColumn("shards", F.lit(shards))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): for each query the ``k`` vectors of largest inner product found.

    Both frames have (id, vector) as their first two columns, the ids of type long. Rows with the query's id
    are no candidates. Ties go to the smaller id; a query with fewer candidates gets all. Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do rows without an id;
    vectors of different lengths don't meet; repeated rows count once; empty tables give no rows.
    """
    named = lambda df: df.select(df[df.columns[0]].alias("vec"), df[df.columns[1]].alias("v")).where(usable("v") & F.col("vec").isNotNull()).withColumn("h", F.xxhash64("v"))
    graphs = index(named(vectors), k + 1)
    shards = (graphs.select("shards").first() or [SHARDS])[0]
    copies = max(1, vectors.sparkSession.sparkContext.defaultParallelism // shards)
    asked = named(queries).dropDuplicates(["vec", "h"]).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asked = asked.select((F.size("v") * F.lit(1 << 32) + F.col("s")).alias("shard"), F.pmod("h", F.lit(copies)).cast("int").alias("copy"), F.lit(None).cast("binary").alias("blob"), "vec", "h", "v")
    kept = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "blob", *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("vec", "h", "v")))
    stream = kept.unionByName(asked).repartition(4 * shards * copies, "shard", "copy").sortWithinPartitions("shard", "copy", F.col("blob").isNull())

    def search(graph: dict, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = graph["ids"], graph["bounds"]
        q = matrix(rows.column("v")).astype(np.float64)
        pool, _ = beam_search(graph["lifted"], graph["graph"], int(graph["start"]), np.pad(q, ((0, 0), (0, 1))).astype(np.float32))
        out: list[list] = [[], [], [], []]
        for i, (vec, h) in enumerate(zip(rows.column("vec").to_pylist(), rows.column("h").to_pylist())):
            near = pool[i][pool[i] >= 0]
            scores = graph["x"][near].astype(np.float64) @ q[i]
            found = sorted((-s, int(v)) for r, s in zip(near.tolist(), scores.tolist()) for v in ids[bounds[r] : bounds[r + 1]] if v != vec)[:k]
            for column, values in zip(out, ([vec] * len(found), [h] * len(found), [v for _, v in found], [-s for s, _ in found])):
                column += values
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "h", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, at = None, None  # each shard's graph comes before its queries
        for batch in batches:
            shard = batch.column(0).to_numpy()
            blobs = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(blobs).tolist() + [len(batch)]:
                first = int(np.flatnonzero(blobs[:i])[-1]) + 1 if blobs[:i].any() else 0
                for a in range(first, i, QUERIES):
                    rows = batch.slice(a, min(QUERIES, i - a))
                    here = shard[a : a + len(rows)] == at  # vectors of a length that no candidate has meet no graph
                    if here.any():
                        yield search(graph, rows if here.all() else rows.filter(pa.array(here)))
                if i < len(batch):
                    graph = dict(np.load(io.BytesIO(batch.column(2)[i].as_py())))
                    graph["lifted"], at = lift(graph["x"]), shard[i]

    hits = stream.mapInArrow(run, "query_id long, h long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
