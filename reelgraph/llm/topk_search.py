"""Exact top-k by inner product through a pivot-distance index.

Every vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest length, and a query one
more that is zero; then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and the nearest vectors are those of the
highest inner product.  Vectors are keyed by their nearest pivot and their distance to it; the vectors
of a pivot, sorted by distance, are cut into annuli of about ``ANNULUS_ROWS`` rows (a large annulus
of equal distances into several).

A query's annuli are sorted by the least distance that the triangle inequality leaves to it,
|d(q,p) - d(x,p)| <= d(q,x), and expanded in that order, in rounds: its own annulus, then the next 8, the
next 64 and so on.  Each round raises the k-th best score, and the query stops at the first annulus that
cannot reach it, so most are never read.  Scores are exact integers; the bound may only be widened by
rounding.

Pivots are drawn from a bounded sample, the ``SAMPLE_ROWS`` vectors that come first by a hash of their
ids; every vector is indexed.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do
those without an id; a vector shorter than the longest counts as continued by zeros; ties go to the
smaller id; rows that repeat an id are rows of their own, as queries with a list each, and as candidates,
also of each other; fewer candidates than k give fewer rows; other columns are ignored; no vectors give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, held, materialize

SCALE = 64
SAMPLE_ROWS, PIVOTS = 4096, 64
ANNULUS_ROWS, QUERY_ROWS = 4096, 1024
#: Annuli at most: above, each holds more rows, so that their limits can be sent to all workers.
MOST_ANNULI = 200_000
#: How many times as many annuli a round expands as the one before; queries that meet an annulus at once, about.
GROWTH, TOGETHER = 8, 8192
#: Distances of queries to annuli that a worker holds at once.
CELLS = 4_000_000
_INDEX = "pivot int, place double, row_ids binary, ids binary, vectors binary, low double, high double"
_PAIRS = "asking bigint, block bigint, at binary, row_ids binary, ids binary, vectors binary, floors binary"
_HITS = "asking bigint, at int, query_id bigint, vec_id bigint, vec_row bigint, score bigint"
NOTHING = -(2**62)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns id, row (unique) and v (array of long) of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, continued by zeros."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Space:
    """Pivots in the space with one more component, and distances to them."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = longest
        points = self.lift(sample)
        chosen = [0]
        near = ((points - points[0]) ** 2).sum(axis=1)
        while len(chosen) < min(PIVOTS, len(points)) and near.max() > 0:  # the farthest point comes next
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        pivots = points[chosen]
        for _ in range(3):
            owner = self._squares(points, pivots).argmin(axis=1)
            pivots = np.stack([points[owner == p].mean(axis=0) if (owner == p).any() else pivots[p] for p in range(len(pivots))])
        self.pivots = pivots

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.concatenate((x, more[:, None]), axis=1)

    @staticmethod
    def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return np.sqrt(self._squares(self.lift(x, query), self.pivots))


def _keyed(rows: DataFrame, space, width: int, query: bool) -> DataFrame:
    """Nearest pivot and distance of each vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("top-k search")
        for batch in batches:
            if batch.num_rows:
                d = space.value.distances(_matrix(batch.column(2), width), query)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])], ["id", "row", "v", "pivot", "place"])

    return rows.select("id", "row", "v").mapInArrow(run, "id bigint, row bigint, v array<bigint>, pivot int, place double")


def _blocks(keyed: DataFrame, most: int, width: int, kind: str) -> DataFrame:
    """Sorted rings of each pivot, about ``most`` rows at most, a row each."""
    # ranges of the distance whose numbers of rows are known bound what one group holds
    wide = keyed.withColumn("cell", F.floor(F.col("place")).cast("long"))
    # small neighbouring cells share a ring: cells are numbered by the rows before them
    run = Window.partitionBy("pivot").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = wide.groupBy("pivot", "cell").count().withColumn("before", F.coalesce(F.sum("count").over(run), F.lit(0)))
    rings = sizes.select("pivot", "cell", F.when(F.col("count") > most // 2, -1 - F.col("cell")).otherwise(F.floor(F.col("before") / (most // 2))).alias("ring"), F.ceil(F.col("count") / most).cast("int").alias("parts"))
    joined = wide.join(rings, ["pivot", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def pack(of: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("place", "ascending"), ("id", "ascending"), ("row", "ascending")]).combine_chunks()
        place = rows["place"].to_numpy()
        v = _matrix(rows["v"].combine_chunks(), width).astype(kind)
        raw = [rows["row"].to_numpy().astype("<i8"), rows["id"].to_numpy().astype("<i8"), v]
        return pa.table([pa.array([of[0].as_py()], pa.int32()), [float(place.mean())], *[pa.array([x.tobytes()], pa.binary()) for x in raw], [float(place[0])], [float(place[-1])]], ["pivot", "place", "row_ids", "ids", "vectors", "low", "high"])

    return joined.select("id", "row", "v", "pivot", "place", "ring", "part").groupBy("pivot", "ring", "part").applyInArrow(pack, _INDEX)


def _vectors(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of each query that reach its floor, without its own row, ties to the smaller id."""
    out = []
    for row, mine, floor in zip(score, own, floors):
        at = np.flatnonzero((row >= floor) & (rows != mine))
        if len(at) > k:
            edge = np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= edge]
        order = at[np.lexsort((rows[at], ids[at], -row[at]))[:k]]
        out.append((ids[order], rows[order], row[order]))
    return out


def _expanded(queries: DataFrame, space, annuli, first: int, last: int, kind: str) -> DataFrame:
    """Places ``first`` to ``last`` of each query's sorted annuli, as far as they may reach its k-th best score.

    ``queries`` has the k-th best scores so far, ``known`` (at, kth).  One row per block of queries and annulus.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("top-k search")
        pivot, low, high, block = (annuli.value[c] for c in ("pivot", "low", "high", "block"))
        step = max(1, CELLS // max(1, len(block)))
        for batch in batches:
            for r in batch.to_pylist():
                ids, rows = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["row_ids"], "<i8")
                q = _vectors(r["vectors"], len(ids), kind)
                floor = np.full(len(ids), NOTHING, np.int64)
                for known in r["known"] or ():
                    floor[known["at"]] = known["kth"]
                chosen: list[tuple[np.ndarray, np.ndarray]] = []  # queries and annuli
                for lo in range(0, len(ids), step):
                    part = q[lo : lo + step]
                    d = space.value.distances(part, True)
                    gap = np.maximum(np.maximum(d[:, pivot] - high, low - d[:, pivot]), 0)
                    own = pivot[None, :] == d.argmin(axis=1)[:, None]
                    # own annuli come first among those as near
                    order = np.argsort(np.where(own, gap * (1 - 1e-9) - 1e-9, gap), axis=1, kind="stable")[:, first:last]
                    near = np.take_along_axis(gap, order, axis=1)
                    # the greatest inner product that the triangle inequality leaves in an annulus
                    size = (part.astype(np.float64) ** 2).sum(axis=1)[:, None]
                    reach = (size + space.value.longest - np.maximum(near * (1 - 1e-9) - 1e-6, 0) ** 2) / 2
                    row, column = np.nonzero(reach + np.abs(reach) * 1e-9 + 1 >= floor[lo : lo + step, None])
                    chosen.append((row + lo, order[row, column]))
                asks, wanted = (np.concatenate([c[i] for c in chosen]) for i in (0, 1))
                by = np.argsort(wanted, kind="stable")
                asks, wanted = asks[by], wanted[by]
                edges = np.flatnonzero(np.concatenate(([True], wanted[1:] != wanted[:-1]))) if len(wanted) else []
                for a, b in zip(edges, [*edges[1:], len(wanted)]):
                    at = asks[a:b]
                    cells = [at.astype("<i4"), rows[at], ids[at], q[at].astype(kind), floor[at]]
                    yield pa.RecordBatch.from_arrays([pa.array([r["asking"]]), pa.array([int(block[wanted[a]])]), *[pa.array([x.tobytes()], pa.binary()) for x in cells]], ["asking", "block", "at", "row_ids", "ids", "vectors", "floors"])

    return queries.select("asking", "row_ids", "ids", "vectors", "known").mapInArrow(run, _PAIRS)


def _search(pairs: DataFrame, index: DataFrame, k: int, kind: str, parts: int) -> DataFrame:
    """Best candidates of each query in the annuli it asks for; a group is an annulus and a few blocks of queries."""
    asks = pairs.withColumn("part", F.pmod(F.xxhash64("asking"), F.lit(parts)).cast("int"))
    wanted = asks.select("block", "part").distinct().join(index.select("block", F.col("row_ids").alias("x_rows"), F.col("ids").alias("x_ids"), F.col("vectors").alias("x")), "block")

    def run(of: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for x in right.to_pylist():
            ids, rows = np.frombuffer(x["x_ids"], "<i8"), np.frombuffer(x["x_rows"], "<i8")
            v = _vectors(x["x"], len(ids), kind)
            for r in left.to_pylist():
                at, own, qi = np.frombuffer(r["at"], "<i4"), np.frombuffer(r["row_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                found = _best(scores(_vectors(r["vectors"], len(at), kind), v), ids, rows, own, np.frombuffer(r["floors"], "<i8"), k)
                sizes = [len(i) for i, _, _ in found]
                for c, cells in zip(columns, (np.full(sum(sizes), r["asking"]), np.repeat(at, sizes), np.repeat(qi, sizes), *(np.concatenate([f[i] for f in found]) for i in range(3)))):
                    c.append(cells)
        kinds = (np.int64, np.int32, np.int64, np.int64, np.int64, np.int64)
        return pa.table([pa.array(np.concatenate(c).astype(t) if c else np.empty(0, t)) for c, t in zip(columns, kinds)], ["asking", "at", "query_id", "vec_id", "vec_row", "score"])

    right = wanted.select(F.col("block").alias("block"), F.col("part").alias("part"), "x_rows", "x_ids", "x")
    return asks.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, _HITS)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asking", "at").orderBy(F.desc("score"), "vec_id", "vec_row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", searched: list | None = None) -> DataFrame:
    """The k best of all rows for each row whose id ``every`` divides: query_id, rank, vec_id, score.

    ``searched`` gets the number of rows of vectors that each round compares.
    """
    spark = vectors.sparkSession
    rows = materialize(integer_vectors(vectors, id_col, vector_col), "vectors")
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, longest, width, largest = rows.agg(F.count("*"), F.max(squared), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not n:
        forget(rows)
        return empty
    kind = next(f"<i{b}" for b in (1, 2, 4, 8) if largest < 2 ** (8 * b - 1))
    sample = rows.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE_ROWS).select("v").toArrow().combine_chunks()
    space = spark.sparkContext.broadcast(Space(_matrix(sample["v"].combine_chunks(), width), longest))
    index = materialize(_blocks(_keyed(rows, space, width, False), max(ANNULUS_ROWS, -(-2 * n // MOST_ANNULI)), width, kind).withColumn("block", F.monotonically_increasing_id()), "index", "none")
    asked = rows.where(F.col("id") % every == 0) if every > 1 else rows
    queries = materialize(_blocks(_keyed(asked, space, width, True), QUERY_ROWS, width, kind).withColumn("asking", F.monotonically_increasing_id()), "queries", "none")
    table = index.select("block", "pivot", "low", "high").toPandas().sort_values(["pivot", "low", "block"], kind="stable")  # MOST_ANNULI rows, about
    annuli = spark.sparkContext.broadcast({c: table[c].to_numpy() for c in table})
    parts = max(1, -(-asked.count() // TOGETHER))
    best, first, size = None, 0, 1
    while first < len(table):
        known = spark.createDataFrame([], "asking bigint, known array<struct<at: int, kth: bigint>>")
        if best is not None:
            kth = best.groupBy("asking", "at").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
            known = kth.groupBy("asking").agg(F.collect_list(F.struct("at", "kth")).alias("known"))  # QUERY_ROWS at most
        pairs = materialize(_expanded(queries.join(known, "asking", "left"), space, annuli, first, first + size, kind), "pairs", "none")
        if searched is not None:
            searched.append(pairs.select(F.sum(F.length("at") / 4)).first()[0] or 0)
        if not pairs.take(1):
            forget(pairs)
            break
        hits = _search(pairs, index, k, kind, parts)
        before, best = best, materialize(_top(hits if best is None else best.drop("rank").unionByName(hits), k), "best")
        forget(pairs, *([before] if before is not None else []))
        first, size = first + size, size * GROWTH
    forget(rows, queries, index)
    return empty if best is None else best.select("query_id", "rank", "vec_id", "score")
