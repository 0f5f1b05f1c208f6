"""Approximate nearest neighbours by cosine: a robust-pruned directed graph for each shard.

Equal vectors are one class, indexed once; its least ids are kept beside it. Classes are dealt into shards by a
hash of the vector. In a shard a graph is built in two passes over its vectors: a greedy beam search from the entry
proposes neighbours, relaxed pruning keeps those that no kept one is much nearer to, and back edges are pruned the
same way when a list is full. The graphs are written to the shared folder. Queries go to every shard, a block of a
fixed size at a time: the block is broadcast, its hits are written out, and the next block takes its place, so neither
the driver nor a plan holds more than one. The best of all shards are ranked by the exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches, spool

#: Vectors of a shard (about), out-degree, beams of building and of searching, slack of pruning, queries of a block.
SHARD, DEGREE, BUILD_BEAM, SEARCH_BEAM, SLACK, QUERY_BLOCK = 4096, 32, 48, 96, 1.2, 16384


class Graph:
    """A directed graph over unit vectors."""

    def __init__(self, unit: np.ndarray, edges: np.ndarray, entry: int) -> None:
        self.unit, self.edges, self.entry = unit, edges, entry

    @classmethod
    def build(cls, unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, slack: float = SLACK, seed: int = 3, batch: int = 256) -> Graph:
        n = len(unit)
        rng = np.random.default_rng(seed)
        mean = unit.mean(axis=0)
        own = cls(unit, np.full((n, degree), -1, np.int32), int((unit @ mean).argmax()))
        if n <= 1:
            return own
        fill = min(degree // 2, n - 1)
        own.edges[:, :fill] = (np.arange(n)[:, None] + rng.integers(1, n, (n, fill))) % n
        for relax in (1.0, slack):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                part = order[at : at + batch]
                near, _, seen = own.search(unit[part], beam, keep_seen=True)
                back: dict[int, list[int]] = {}
                for k, v in enumerate(part.tolist()):
                    pool = np.unique(np.concatenate([near[k], seen[k], own.edges[v]]))
                    kept = own._prune(v, pool[(pool >= 0) & (pool != v)], relax, degree)
                    own.edges[v] = -1
                    own.edges[v, : len(kept)] = kept
                    for w in kept.tolist():
                        back.setdefault(w, []).append(v)
                for w, new in back.items():
                    have = own.edges[w][own.edges[w] >= 0]
                    pool = np.unique(np.concatenate([have, new]))
                    if len(pool) > degree:
                        pool = own._prune(w, pool, relax, degree)
                    own.edges[w] = -1
                    own.edges[w, : len(pool)] = pool
        return own

    def _prune(self, v: int, pool: np.ndarray, relax: float, degree: int) -> np.ndarray:
        """Of pool, nearest first, those that no kept one is relax times nearer to than v is. Distances are squared chords."""
        if not len(pool):
            return pool
        x = self.unit[pool]
        d = 2 - 2 * (x @ self.unit[v])
        order = np.argsort(d, kind="stable")[: 4 * degree]
        pool, d, x = pool[order], d[order], x[order]
        among = 2 - 2 * (x @ x.T)
        alive, kept = np.ones(len(pool), bool), []
        for k in range(len(pool)):
            if alive[k]:
                kept.append(k)
                if len(kept) == degree:
                    break
                alive &= relax * relax * among[k] > d
        return pool[kept]

    def search(self, queries: np.ndarray, beam: int, keep_seen: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """For each query the beam's vertices, nearest first (-1: none), their cosines, and the vertices expanded."""
        q, n = len(queries), len(self.unit)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -np.inf, self.unit.dtype)
        done = np.zeros((q, beam), bool)
        ids[:, 0] = self.entry
        sims[:, 0] = queries @ self.unit[self.entry]
        met = np.zeros((q, n), bool)
        met[:, self.entry] = True
        seen = []
        while True:
            open_ = (ids >= 0) & ~done
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                break
            at = open_[rows].argmax(axis=1)
            v = ids[rows, at]
            done[rows, at] = True
            if keep_seen:
                step = np.full(q, -1, np.int64)
                step[rows] = v
                seen.append(step)
            next_ = self.edges[v].astype(np.int64)
            real = next_ >= 0
            fresh = real & ~met[rows[:, None], np.maximum(next_, 0)]
            r, c = np.nonzero(fresh)
            met[rows[r], next_[r, c]] = True
            cos = np.full(next_.shape, -np.inf, self.unit.dtype)
            cos[r, c] = np.einsum("ij,ij->i", self.unit[next_[r, c]], queries[rows[r]])
            all_ids = np.concatenate([ids[rows], np.where(fresh, next_, -1)], axis=1)
            all_sims = np.concatenate([sims[rows], cos], axis=1)
            all_done = np.concatenate([done[rows], np.zeros_like(fresh)], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[rows] = np.take_along_axis(all_ids, best, 1)
            sims[rows] = np.take_along_axis(all_sims, best, 1)
            done[rows] = np.take_along_axis(all_done, best, 1)
        return ids, sims, (np.stack(seen, axis=1) if seen else np.zeros((q, 0), np.int64)) if keep_seen else None


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """(class, v, ids): distinct usable vectors and the k + 1 least ids that have each; a class is known by its least id. The ids are ranked in a window that Spark limits before it shuffles, so a vector that many rows share sends a few rows a task."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null").where(usable(F.col("v")))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("class"), "v", "ids")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def index(own: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, entry, n, dim, classes, unit, edges), blobs: a row for each shard of own's classes. own must be spooled. Vectors of another length than the most common one are dealt to shards of their own."""
    sizes = {r["dim"]: r["n"] for r in own.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # lengths of vectors
    number = F.lit(1)
    for dim, n in sizes.items():
        number = F.when(F.size("v") == dim, F.lit(max(1, -(-n // shard)))).otherwise(number)
    dealt = own.select("class", "v", F.concat_ws("-", F.size("v"), F.pmod(F.xxhash64("v"), number)).alias("shard"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class")
        unit = _unit(np.array(pdf["v"].tolist(), np.float64)).astype(np.float32)
        g = Graph.build(unit)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "entry": [g.entry], "n": [len(pdf)], "dim": [unit.shape[1]], "classes": [pdf["class"].to_numpy("<i8").tobytes()], "unit": [unit.tobytes()], "edges": [g.edges.tobytes()]})

    return dealt.groupBy("shard").applyInPandas(build, "shard string, entry int, n int, dim int, classes binary, unit binary, edges binary")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, beam: int = SEARCH_BEAM, shard: int = SHARD) -> DataFrame:
    """vectors: (vec_id, embedding). For each row where is_query (on vec_id) holds: query_id, rank, vec_id, score of the k nearest other rows found, by cosine in double precision on the vectors as given; equal scores by smaller id; all rows, if fewer. Rows with a null id or an unusable vector take no part; repeated ids are rows of one id; only vectors of a query's own length are compared; an empty table gives an empty one."""
    spark = vectors.sparkSession
    small_batches(spark)
    own = spool(_measured(classes(vectors, k)), "ann-classes")
    graphs = spool(index(own, shard), "ann-graphs")
    asked = vectors.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v")).where("query_id is not null").where(usable(F.col("v"))).distinct()
    numbered = spool(_measured(asked), "ann-queries")
    many = max(1, -(-numbered.count() // QUERY_BLOCK))
    path = shared_path(spark, "ann-hits")
    for b in range(many):
        block = numbered.where(F.pmod(F.xxhash64("query_id", "v"), F.lit(many)) == b).select("query_id", "v").orderBy("query_id").toArrow()  # about QUERY_BLOCK rows
        sent = spark.sparkContext.broadcast(_by_length(block))
        _searched(graphs, sent, k + 1, beam).write.mode("append").parquet(path)
        sent.destroy()
    hits = spark.read.schema(_HIT).parquet(path)
    # of all shards' hits those that are as near as the last one wanted, but for the search's rounding
    every = Window.partitionBy("query_id").orderBy(F.desc("near")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = hits.withColumn("last", F.nth_value("near", k + 1).over(every)).where("last is null or near >= last - 2e-6").select("query_id", "class")
    # each hit class brings its least ids, and the exact score
    members = own.select(F.col("class").alias("c"), "ids", F.col("scaled").alias("w"), F.col("norm").alias("w_norm"))
    met = best.join(members, F.col("class") == F.col("c")).join(numbered.select(F.col("query_id").alias("q"), F.col("scaled").alias("u"), F.col("norm").alias("u_norm")), F.col("query_id") == F.col("q"))
    scored = met.select("query_id", "ids", (dot(F.col("u"), F.col("w")) / (F.col("u_norm") * F.col("w_norm"))).alias("score"))
    each = scored.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def scaled(x: Column) -> Column:
    """x divided by a power of two near its largest component. That changes no digit, and neither tiny nor huge components leave the range of doubles when they are squared."""
    power = F.floor(F.log2(F.array_max(F.transform(x, F.abs))))
    half = F.floor(power / 2)  # in two steps: the power itself may have no double as its inverse
    return F.transform(x, lambda p: p / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), power - half))


def _measured(df: DataFrame, vector: str = "v") -> DataFrame:
    """df with scaled and norm, from which cosines in double precision are a product away."""
    return df.withColumn("scaled", scaled(F.col(vector))).withColumn("norm", F.sqrt(dot(F.col("scaled"), F.col("scaled"))))


_HIT = "query_id long, class long, near float"


def _by_length(block: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the queries' ids and unit vectors."""
    ids, v = block.column("query_id").to_numpy(), block.column("v").combine_chunks()
    size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        x = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
        out[dim] = ids[own], _unit(x).astype(np.float32)
    return out


def _searched(graphs: DataFrame, queries: Broadcast, k: int, beam: int) -> DataFrame:
    """(query_id, class, near): the k nearest classes of every shard, and those as near as the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if r["dim"] not in queries.value:
                    continue
                ids, asked = queries.value[r["dim"]]
                own = np.frombuffer(r["classes"], "<i8")
                unit = np.frombuffer(r["unit"], np.float32).reshape(r["n"], r["dim"])
                edges = np.frombuffer(r["edges"], np.int32).reshape(r["n"], -1)
                g = Graph(unit, edges, r["entry"])
                for x in range(0, len(ids), 512):
                    got, sims, _ = g.search(asked[x : x + 512], min(beam, max(r["n"], 1)))
                    last = sims[:, min(k, sims.shape[1]) - 1]
                    good = (got >= 0) & (sims >= last[:, None] - np.float32(1e-6))
                    row, c = np.nonzero(good)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x : x + 512][row]), pa.array(own[got[row, c]]), pa.array(sims[row, c].astype(np.float32))], ["query_id", "class", "near"])

    return graphs.mapInArrow(run, _HIT)
