"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors that take part are collapsed to distinct ones, dealt by hash into shards of about `shard_rows`, and each shard's graph is
built in a task of its own: points enter in growing batches, each batch searches the graph so far and itself, and neighbours are
chosen by the diversity rule. A shard is one row: its vectors and, for each level, a flat array of neighbours. For inner products
the graph is over vectors with one more component that makes all lengths of the shard equal. Every query goes to every shard of
its length and streams past the shard's graph, which is read once (or, with fewer shards than cores, once a core); the shards'
results are merged. A query costs a search a shard, so shards should be as large as a task's memory allows. Scores are inner
products in double precision of the original vectors. Graphs and queries are scaled, so vectors of any length that doubles hold
are told apart; a shard whose longest vector is more than WIDE times its shortest is searched in double precision.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without id;
vectors are compared with those of their own length only; repeated rows count once; ties go to the smaller id; with fewer than k
candidates all are returned; a score beyond doubles is infinite, and one that is no number (infinite terms of both signs) ranks last,
as minus infinity; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ._common import bounded, mix, stage

M, BUILD_EF, SEARCH_EF = 16, 96, 160
SHARD_ROWS = 32_768
MOST_BATCH = 256
#: Longest against shortest vector of a shard up to which single precision serves its graph.
WIDE = 64.0


class Graph:
    """levels[l]: neighbours of every point at level l, as an array (points, width) with -1 where there is none."""

    def __init__(self, points: np.ndarray, levels: list[np.ndarray], entry: int):
        self.points, self.levels, self.entry = points, levels, entry

    def beam(self, queries: np.ndarray, level: int, start: np.ndarray, ef: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the ef best points met from start (queries, k), best first; -1 where fewer."""
        rows = np.arange(len(queries))[:, None]
        links, n = self.levels[level], len(self.points)
        seen = np.zeros((len(queries), n + 1), bool)
        seen[rows, start] = True
        ids = np.full((len(queries), ef), -1)
        ids[:, : start.shape[1]] = start
        sims = np.where(ids >= 0, np.einsum("qd,qkd->qk", queries, self.points[ids]), -np.inf)
        open_ = ids >= 0
        while open_.any():
            rank = np.argsort(np.where(open_, -sims, np.inf), axis=1, kind="stable")[:, :at_once]
            chosen = np.where(open_[rows, rank], ids[rows, rank], -1)
            open_[rows, rank] = False
            near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(queries), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near >= 0) & seen[rows, near]] = -1
            seen[rows, near] = True
            new = np.where(near >= 0, np.einsum("qd,qkd->qk", queries, self.points[near]), -np.inf)
            all_ids, all_sims = np.concatenate([ids, near], 1), np.concatenate([sims, new], 1)
            all_open = np.concatenate([open_, near >= 0], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids, sims, open_ = all_ids[rows, best], all_sims[rows, best], all_open[rows, best]
        return ids, sims

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        start = np.full((len(queries), 1), self.entry)
        for level in range(len(self.levels) - 1, 0, -1):
            start = self.beam(queries, level, start, 1)[0]
        return self.beam(queries, 0, start, min(ef, len(self.points)))[0]

    def choose(self, of: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
        """Of each point's candidates (nearest first) up to width that are nearer to it than to any chosen before; then the nearest of the rest."""
        p = self.points[ids]
        sims = np.einsum("qd,qkd->qk", self.points[of], p)
        among = np.einsum("qid,qjd->qij", p, p)
        there = ids >= 0
        taken = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            taken[:, k] = there[:, k] & (taken.sum(1) < width) & ~((among[:, k] > sims[:, k : k + 1]) & taken).any(1)
        order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(ids, order, 1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def link(self, level: int, of: np.ndarray, ids: np.ndarray) -> None:
        """Give the points `of` neighbours from their candidates, and those the points in turn."""
        links = self.levels[level]
        width = links.shape[1]
        links[of] = self.choose(of, ids, width)
        source = np.repeat(of, width)
        target = links[of].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, first, n = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(who), 512):
            w, f, c = who[lo : lo + 512], first[lo : lo + 512], n[lo : lo + 512]
            more = np.full((len(w), int(c.max())), -1)
            for i, (a, k) in enumerate(zip(f, c, strict=True)):
                more[i, :k] = source[a : a + k]
            both = np.concatenate([links[w], more], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.where(both >= 0, np.einsum("qd,qkd->qk", self.points[w], self.points[both]), -np.inf)
            both = np.take_along_axis(both, np.argsort(-sims, axis=1, kind="stable"), 1)
            fits = (both >= 0).sum(1) <= width
            out = np.pad(both, ((0, 0), (0, max(0, width - both.shape[1]))), constant_values=-1)[:, :width]
            if not fits.all():
                out[~fits] = self.choose(w[~fits], both[~fits][:, : 3 * width], width)
            links[w] = out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their largest component, each of its own."""
    return vectors / np.maximum(np.abs(vectors).max(1, keepdims=True), np.finfo(float).tiny)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """A shard's vectors over its largest component, with one more component that makes all lengths equal."""
    v = vectors / max(np.abs(vectors).max(), np.finfo(float).tiny)
    square = (v * v).sum(1)
    single = square.max() <= WIDE * WIDE * square.min()
    return np.column_stack([v, np.sqrt(np.maximum(square.max() - square, 0))]).astype(np.float32 if single else np.float64)


def build(vectors: np.ndarray) -> Graph:
    """The graph over double vectors, for inner products."""
    points = lifted(vectors)
    n = len(points)
    draw = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
    top = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(M)).astype(int), 6)
    order = np.argsort(-top, kind="stable")
    points, top = points[order], top[order]
    graph = Graph(points, [np.full((n, 2 * M if level == 0 else M), -1) for level in range(top[0] + 1)], 0)
    done = 1
    while done < n:
        batch = np.arange(done, min(n, done + min(done, MOST_BATCH)))
        q = points[batch]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        own = batch[np.argsort(-among, axis=1, kind="stable")[:, : 2 * M]]
        start = np.zeros((len(batch), 1), int)
        for level in range(top[0], -1, -1):
            here = top[batch] >= level
            found, _ = graph.beam(q, level, start, min(BUILD_EF, done) if here.any() else 1)
            start = found[:, :1]
            if here.any():
                mine = np.where(top[own[here]] >= level, own[here], -1)
                cand = np.concatenate([found[here], mine], 1)
                sims = np.where(cand >= 0, np.einsum("qd,qkd->qk", q[here], points[cand]), -np.inf)
                cand = np.take_along_axis(cand, np.argsort(-sims, axis=1, kind="stable"), 1)[:, : BUILD_EF + M]
                graph.link(level, batch[here], cand)
        done = batch[-1] + 1
    for level, links in enumerate(graph.levels):  # back to the given order
        old = np.append(order, -1)
        moved = np.full_like(links, -1)
        moved[order] = old[links]
        graph.levels[level] = moved
    back = np.empty_like(points)
    back[order] = points
    return Graph(back, graph.levels, int(order[0]))


def taking_part(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("vector")
    kind = "float" if df.schema[vector_col].dataType == ArrayType(FloatType(), df.schema[vector_col].dataType.containsNull) else "double"
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast(f"array<{kind}>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & sound).distinct()


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.large_binary()).cast(pa.binary())


def _vectors(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length, as doubles."""
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shard whose vectors are the whole partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    ids = rows.column("ids").combine_chunks()
    order = np.argsort(ids.flatten().to_numpy()[np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy()))[:-1]], kind="stable")
    rows = rows.take(pa.array(order))
    ids = rows.column("ids").combine_chunks()
    v = _vectors(rows.column("vector").combine_chunks())
    g = build(v)
    shard = {"shard": rows.column("shard")[:1].combine_chunks(), "query": pa.array([None], pa.int64()), "vector": pa.array([None], pa.list_(pa.float64()))}
    flat = {"vectors": _binary(v), "ids": _binary(ids.flatten().to_numpy().astype(np.int64)), "n_ids": _binary(pc.list_value_length(ids).to_numpy().astype(np.int32)), "entry": pa.array([g.entry], pa.int32())}
    yield pa.RecordBatch.from_pydict(shard | flat | {"levels": pa.array([[x.astype(np.int32).tobytes() for x in g.levels]], pa.list_(pa.binary()))})


#: Rows of an index, which holds shards, and of a search, which holds queries too.
ROWS = "shard int, query long, vector array<double>, vectors binary, ids binary, n_ids binary, entry int, levels array<binary>"


def index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Shards (ROWS; up to k + 1 ids for each distinct vector) and dims: dim, base, shards (the numbers of a length's shards). vectors: id, vector."""
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    distinct = vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = stage(distinct.withColumn("dim", F.size("vector")), "vectors")
    dims = distinct.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    before = Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)
    dims = stage(dims.withColumn("base", F.coalesce(F.sum("shards").over(before), F.lit(0)).cast("int")), "dims")
    total = dims.agg(F.sum("shards")).first()[0] or 1
    dealt = distinct.join(bounded(dims), "dim").withColumn("shard", (F.col("base") + F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("shards"))).cast("int"))
    dealt = dealt.select("shard", F.col("vector").cast("array<double>").alias("vector"), "ids").repartitionById(total, "shard")
    return stage(dealt.mapInArrow(_graph, ROWS), "hnsw"), dims


def search(shards: DataFrame, dims: DataFrame, queries: DataFrame, k: int, ef: int = SEARCH_EF) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest that the shards' graphs give. queries: id, vector."""
    total = dims.agg(F.sum("shards")).first()[0] or 1
    parts = max(1, queries.sparkSession.sparkContext.defaultParallelism // total)
    asked = queries.withColumn("dim", F.size("vector")).join(bounded(dims), "dim")
    asked = asked.withColumn("shard", F.explode(F.sequence("base", F.col("base") + F.col("shards") - 1))).withColumn("task", (F.col("shard") * parts + F.pmod(F.xxhash64("id"), F.lit(parts))).cast("int"))
    both = shards.withColumn("task", F.explode(F.sequence(F.col("shard") * parts, F.col("shard") * parts + parts - 1)))
    both = both.unionByName(asked.select("shard", F.col("id").alias("query"), F.col("vector").cast("array<double>").alias("vector"), "task"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            is_shard = np.asarray(batch.column("query").is_null())
            if is_shard[:1].any():
                at = lambda name, kind: np.frombuffer(batch.column(name)[0].as_buffer(), kind)  # noqa: B023, E731
                n_ids = at("n_ids", np.int32)
                v, ids, edge = at("vectors", np.float64).reshape(len(n_ids), -1), at("ids", np.int64), np.append(0, np.cumsum(n_ids))
                graph = Graph(lifted(v), [np.frombuffer(b.as_buffer(), np.int32).reshape(len(v), -1).astype(np.int64) for b in batch.column("levels")[0].values], batch.column("entry")[0].as_py())
                batch = batch.slice(1)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                asked, mine = part.column("query").to_numpy(), _vectors(part.column("vector"))
                found = graph.search(np.column_stack([scaled(mine), np.zeros(len(mine))]).astype(graph.points.dtype), max(ef, 2 * k))
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = np.einsum("qd,qkd->qk", mine, v[found])
                scores = np.where((found >= 0) & ~np.isnan(exact), exact, -np.inf)
                order = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                found, scores = np.take_along_axis(found, order, 1), np.take_along_axis(scores, order, 1)
                who, col = np.nonzero(found >= 0)
                hit = found[who, col]
                members = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_ids[hit])).astype(np.int32)), pa.array(np.concatenate([ids[edge[h] : edge[h + 1]] for h in hit])))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(asked[who]), "members": members, "score": pa.array(scores[who, col])})

    hits = both.repartitionById(total * parts, "task").sortWithinPartitions(F.col("query").asc_nulls_first()).drop("task", "shard")
    hits = hits.mapInArrow(run, "query_id long, members array<long>, score double")
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.get("members", F.lit(0))))).where(F.col("nth") <= k + 1)
    hits = hits.select("query_id", F.explode("members").alias("vec_id"), "score").where("query_id <> vec_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest by inner product of each row whose id is divisible by `every`, from all rows but its own."""
    vectors = taking_part(df, id_col, vector_col)
    return search(*index(vectors, k, shard_rows), stage(vectors.where(F.col("id") % every == 0), "queries"), k)
