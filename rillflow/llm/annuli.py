"""Exact top-k by inner product over a pivot-distance index.

A vector v of the table gets one more coordinate, sqrt(M - |v|^2) with M the largest squared norm, and
a query gets 0 there; then |q - v|^2 = |q|^2 + M - 2 <q, v>, so the highest scores are the nearest
vectors and the triangle inequality holds. Vectors are keyed by their nearest pivot and their distance
to it; a pivot's vectors form annuli, sorted by distance, and an annulus is stored in blocks. For a
query at distance d from the pivot, nothing in an annulus from a to b is nearer than max(a - d, d - b).
A query first visits the annuli with the smallest of these bounds; its k-th score then tells which
others can still matter, and only those are visited. Queries go in blocks, and an annulus of many
blocks is dealt out in shares. The join of both streams the queries' blocks, as many as the queries
make, past the vectors' blocks of a share, SHARE at most, so that no task holds an annulus or the
queries of one. Blocks hold the smallest integers that fit.

Pivots come from a bounded sample (the PIVOTS_MOST vectors of the smallest hash at most); all vectors
are indexed and the result is exact.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as
queries nor as candidates; shorter vectors count as padded with zeros; repeated rows are candidates and
queries each by itself, and a row is not its own candidate; an empty table gives an empty result; extra
columns are ignored. Components are floor(64 x), scores exact integers (clipped to 64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, stored, text_batches

SCALE, TOP, EVERY = 64, 20, 20
PIVOTS_LEAST, PIVOTS_MOST, ROWS_A_PIVOT, RINGS = 4, 64, 4096, 8
#: Vectors in a block, queries in a block, annuli of the first visit, and blocks of an annulus that share a visit.
BLOCK, QUERIES, FIRST, SHARE = 1024, 256, 4, 16
EXACT, EXACT_SINGLE = 2.0**53, 2.0**24


def vectors(table: DataFrame) -> DataFrame:
    """__row, vec_id, v, norm: the usable rows in integers (as doubles), stored."""
    e = F.col("embedding")
    usable = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = table.select("vec_id", F.when(usable, v).alias("v")).filter("v IS NOT NULL")
    return stored(rows.select(F.monotonically_increasing_id().alias("__row"), F.col("vec_id").cast("long"), "v", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("norm")), "top-vectors")


def matrix(v: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(v), dim))
    flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.array(v.offsets)
    ends = ends - ends[0]
    size = np.diff(ends)
    rows = np.repeat(np.arange(len(v)), size)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1], size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' in exact integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < EXACT:
        kind = np.float32 if bound < EXACT_SINGLE else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def narrowest(most: float) -> type:
    """The type that blocks hold components in, if no vector's squared norm is above ``most``."""
    return next((t for t in (np.int8, np.int16, np.int32) if most <= float(np.iinfo(t).max) ** 2), np.float64)


def best(query: np.ndarray, score: np.ndarray, missing: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Where each query's best rows stand: by score, then smaller id, those without an id last."""
    order = np.lexsort((ids, missing, ~score, query))
    query = query[order]
    return order[np.arange(len(order)) - np.searchsorted(query, query) < top]


class Index:
    """Pivots, and each annulus's number and bounds: at most PIVOTS_MOST x RINGS of them."""

    def __init__(self, pivots: np.ndarray, most: float) -> None:
        self.pivots, self.most = pivots, most
        self.squares = (pivots * pivots).sum(axis=1)
        self.lift = np.sqrt(np.maximum(most - self.squares, 0))

    def from_vectors(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and the distance to it."""
        norm = (v * v).sum(axis=1)
        lift = np.sqrt(np.maximum(self.most - norm, 0))
        d = norm[:, None] + self.squares - 2 * v @ self.pivots.T + (lift[:, None] - self.lift) ** 2
        near = np.argmin(d, axis=1)
        return near, np.sqrt(np.maximum(d[np.arange(len(v)), near], 0))

    def from_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.most - 2 * q @ self.pivots.T, 0))

    def set_annuli(self, rows: list) -> None:
        self.annulus = np.array([r["annulus"] for r in rows], np.int64)
        self.pivot_of = self.annulus // RINGS
        self.low, self.high = np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])

    def best_scores(self, q: np.ndarray) -> np.ndarray:
        """For each query and annulus, a score that nothing in the annulus is above."""
        d = self.from_queries(q)[:, self.pivot_of]
        slack = 1e-6 * (1 + np.sqrt(self.most))
        gap = np.maximum(np.maximum(self.low - d, d - self.high) - slack, 0)
        return ((q * q).sum(axis=1)[:, None] + self.most - gap * gap) / 2 * (1 + 1e-9) + 1


def _visits(queries: DataFrame, index: Index, dim: int, kind: type, first: bool) -> DataFrame:
    """annulus, rows, ids, v, least: the queries of a block that visit an annulus, each with the score it must reach.

    First the FIRST most promising annuli; then the others that can reach a query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, QUERIES):
            q = matrix(b.column(2), dim)
            best = index.best_scores(q)
            early = np.zeros(best.shape, bool)
            np.put_along_axis(early, np.argsort(-best, axis=1, kind="stable")[:, :FIRST], True, axis=1)
            least = np.full(len(q), -np.inf) if first else b.column(3).to_numpy(zero_copy_only=False)
            wanted = early if first else ~early & (best >= least[:, None])
            at = [np.flatnonzero(wanted[:, j]) for j in range(wanted.shape[1])]
            take = [j for j in range(len(at)) if len(at[j])]
            pick = lambda i, kind: pa.array([b.column(i).to_numpy(zero_copy_only=False)[at[j]] for j in take], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array(index.annulus[take], pa.int64()), pick(0, pa.int64()), pick(1, pa.int64()), pa.array([q[at[j]].astype(kind).tobytes() for j in take], pa.binary()), pa.array([least[at[j]] for j in take], pa.list_(pa.float64()))],
                ["annulus", "rows", "ids", "q", "least"],
            )

    columns = ["__row", "vec_id", "v"] + ([] if first else ["least"])
    return queries.select(*columns).mapInArrow(run, "annulus long, rows array<long>, ids array<long>, q binary, least array<double>")


def _visited(blocks: DataFrame, visits: DataFrame, dim: int, kind: type, top: int) -> DataFrame:
    """q_row, query_id, vec_id, score: of the blocks that a query visits in a share, its best rows that reach the query's least score."""

    def numbers(x: pa.ListScalar) -> np.ndarray:
        return x.values.to_numpy(zero_copy_only=False)

    def in_block(q: np.ndarray, q_rows: np.ndarray, least: np.ndarray, v: np.ndarray, v_rows: np.ndarray, v_ids: pa.Array) -> list[np.ndarray]:
        """The query's place, score, whether the id is missing, and id of each row found."""
        score = products(q, v)
        wanted = (score >= least[:, None]) & (v_rows != q_rows[:, None])
        if score.shape[1] > top + 1:  # one more, as a query's own row is none of its best
            wanted &= score >= np.partition(score, -top - 1, axis=1)[:, [-top - 1]]
        at, column = np.nonzero(wanted)
        missing, ids = (x.to_numpy(zero_copy_only=False)[column] for x in (v_ids.is_null(), v_ids.fill_null(0)))
        score = score[at, column]
        keep = best(at, score, missing, ids, top)
        return [x[keep] for x in (at, score, missing, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 64):
            columns, out = [b.column(i) for i in range(9)], [[], [], [], [], []]
            visit = [(x[0].as_py(), x[1].as_py(), x[5].values[0].as_py()) for x in zip(*columns)]
            starts = [i for i in range(len(visit)) if i == 0 or visit[i] != visit[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(visit)]):  # the blocks of one visit, which the join gives one after the other
                q_rows, q_ids, q, least = numbers(columns[5][i]), numbers(columns[6][i]), np.frombuffer(columns[7][i].as_py(), kind).reshape(-1, dim), numbers(columns[8][i])
                found = [in_block(q, q_rows, least, np.frombuffer(columns[4][k].as_py(), kind).reshape(-1, dim), numbers(columns[2][k]), columns[3][k].values) for k in range(i, j)]
                at, score, missing, ids = (np.concatenate(x) for x in zip(*found))
                keep = best(at, score, missing, ids, top)
                for o, x in zip(out, (q_rows[at[keep]], q_ids[at[keep]], ids[keep], missing[keep], score[keep])):
                    o.append(x)
            if out[0]:
                q_row, query_id, ids, missing, score = (np.concatenate(o) for o in out)
                yield pa.RecordBatch.from_arrays([pa.array(q_row, pa.int64()), pa.array(query_id, pa.int64()), pa.array(ids, pa.int64(), mask=missing), pa.array(score, pa.int64())], ["q_row", "query_id", "vec_id", "score"])

    # the right side of a merge join is the one that is held, key by key
    joined = visits.join(blocks.hint("merge"), ["annulus", "share"]).select("annulus", "share", "__row", "vec_id", "v", "rows", "ids", "q", "least")
    return joined.mapInArrow(run, "q_row long, query_id long, vec_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    by = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)


def search(table: DataFrame, top: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by ``every``, against all other rows."""
    spark = table.sparkSession
    text_batches(spark)
    v = vectors(table)
    seen = v.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"), F.max(F.size("v")).alias("dim")).first()
    n, most, dim = seen["n"], float(seen["most"] or 0), max(1, seen["dim"] or 1)
    kind = narrowest(most)
    n_pivots = min(PIVOTS_MOST, max(PIVOTS_LEAST, n // ROWS_A_PIVOT))
    sample = v.orderBy(F.xxhash64("v"), "__row").limit(4 * n_pivots).select("v").collect()  # 4 x PIVOTS_MOST at most
    pivots = list(dict.fromkeys(tuple(r["v"]) + (0.0,) * (dim - len(r["v"])) for r in sample))[:n_pivots] or [(0.0,) * dim]
    index = Index(np.array(pivots), most)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 4096):
            m = matrix(b.column(2), dim)
            pivot, d = index.from_vectors(m)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(pivot, pa.int64()), pa.array(d)], ["__row", "vec_id", "v", "pivot", "distance"])

    keyed = stored(v.select("__row", "vec_id", "v").mapInArrow(key, "__row long, vec_id long, v array<double>, pivot long, distance double"), "top-keyed")
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("distance", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts")).collect()  # a row per pivot
    by_pivot = {r["pivot"]: r["cuts"] for r in cuts}
    edges = F.array(*[F.array(*[F.lit(float(c)) for c in by_pivot.get(p, [0.0] * (RINGS - 1))]) for p in range(len(pivots))])
    ring = F.size(F.filter(F.element_at(edges, (F.col("pivot") + 1).cast("int")), lambda c: c < F.col("distance")))
    rung = keyed.select("__row", "vec_id", "v", "distance", (F.col("pivot") * RINGS + ring).alias("annulus"))
    bounds = rung.groupBy("annulus").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n")).collect()  # a row per annulus
    index.set_annuli(bounds)
    parts = {r["annulus"]: -(-r["n"] // BLOCK) for r in bounds}
    n_parts = F.element_at(F.array(*[F.lit(parts.get(a, 1)) for a in range(len(pivots) * RINGS)]), (F.col("annulus") + 1).cast("int"))
    placed = rung.withColumn("part", F.pmod(F.xxhash64("__row"), n_parts))
    grouped = placed.groupBy("annulus", "part").agg(F.collect_list(F.struct("__row", "vec_id", "v")).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 64):
            x = b.column(1)
            offsets, inner = np.array(x.offsets) - x.offsets[0].as_py(), x.flatten()
            m = matrix(inner.field(2), dim)
            take = lambda f: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), f)
            yield pa.RecordBatch.from_arrays([b.column(0), take(inner.field(0)), take(inner.field(1)), pa.array([m[i:j].astype(kind).tobytes() for i, j in zip(offsets, offsets[1:])], pa.binary()), b.column(2)], ["annulus", "__row", "vec_id", "v", "share"])

    # an annulus of many blocks is dealt out in shares, and a visit goes to each of them
    shares = F.ceil(n_parts / SHARE).cast("int")
    packed = grouped.select("annulus", "x", (F.col("part") % shares).cast("int").alias("share")).mapInArrow(pack, "annulus long, __row array<long>, vec_id array<long>, v binary, share int")
    blocks = stored(packed, "top-blocks")
    spread = lambda visits: visits.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    queries = v.filter(F.col("vec_id") % every == 0)
    early = stored(_visits(queries, index, dim, kind, True), "top-visits")
    first = stored(_ranked(_visited(blocks, spread(early), dim, kind, top), top).drop("rank"), "top-first")
    kth = first.groupBy("q_row").agg(F.when(F.count(F.lit(1)) >= top, F.min("score").cast("double")).alias("least"))
    with_least = queries.join(kth, queries["__row"] == kth["q_row"], "left").select("__row", "vec_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    late = stored(_visits(with_least, index, dim, kind, False), "top-visits")
    return _ranked(first.unionByName(_visited(blocks, spread(late), dim, kind, top)), top).select("query_id", "rank", "vec_id", "score")
