"""Sequence operators: spines, shifts, segmentation, clustering, count windows and greedy selection."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CLUSTER_GAP, HARD_CUT, SOFT_CUT, SOFT_HIST


def spine(nodes: DataFrame, on: Sequence[str], order: Sequence[str], node: str = "node_id") -> DataFrame:
    """Consecutive rows: PRECEDES if the first ends before the second starts, else OVERLAPS."""
    w = Window.partitionBy(*on).orderBy(*order)
    rows = nodes.withColumns({"dst": F.lead(node).over(w), "rg_next": F.lead("t_start").over(w)}).where("dst is not null")
    return rows.select(*on, F.col(node).alias("src"), "dst", F.when(F.col("t_end") <= F.col("rg_next"), "PRECEDES").otherwise("OVERLAPS").alias("relation_type"))


def chain(nodes: DataFrame, on: Sequence[str], order: Sequence[str], relation: str, node: str = "node_id") -> DataFrame:
    """Consecutive rows, all with one relation (scenes PRECEDES, episodes NARRATIVE_ARC)."""
    w = Window.partitionBy(*on).orderBy(*order)
    return nodes.withColumn("dst", F.lead(node).over(w)).where("dst is not null").select(*on, F.col(node).alias("src"), "dst", F.lit(relation).alias("relation_type"))


def state_shifts(rows: DataFrame, on: Sequence[str], order: Sequence[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before, without empty and unknown states."""
    s = F.lower(F.trim(F.col(state)))
    known = rows.withColumn("rg_s", s).where("rg_s is not null and rg_s not in ('', 'unknown')")
    before = F.lag("rg_s").over(Window.partitionBy(*on).orderBy(*order))
    return known.withColumn("from_state", before).where("from_state is not null and from_state <> rg_s").withColumnRenamed("rg_s", "to_state")


def deltas(frames: DataFrame, on: Sequence[str], order: Sequence[str], distances: dict[str, tuple[str, callable]]) -> DataFrame:
    """Distances to the row before; 0 for the first: name -> (column, function of two columns)."""
    w = Window.partitionBy(*on).orderBy(*order)
    return frames.withColumns({name: F.coalesce(f(F.lag(c).over(w), F.col(c)), F.lit(0.0)) for name, (c, f) in distances.items()})


def segments(frames: DataFrame, on: Sequence[str], order: Sequence[str], hist: Column, emb: Column, hard: float = HARD_CUT, soft: float = SOFT_CUT, soft_hist: float = SOFT_HIST) -> DataFrame:
    """Number of the scene of each row: a new one where the cut is hard, or soft in both signals."""
    w = Window.partitionBy(*on).orderBy(*order)
    cut = (hist > hard) | ((emb > soft) & (hist > soft_hist))
    flag = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(cut, F.lit(False)).cast("int"))
    return frames.withColumn("rg_cut", flag).withColumn("segment", F.sum("rg_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("rg_cut")


def gap_clusters(rows: DataFrame, on: Sequence[str], start: str, end: str, order: Sequence[str], gap: float = CLUSTER_GAP) -> DataFrame:
    """Number of the cluster of each row: a new one where it starts ``gap`` or more after the row before ended."""
    w = Window.partitionBy(*on).orderBy(start, *order)
    flag = F.coalesce((F.col(start) - F.lag(end).over(w) >= gap).cast("int"), F.lit(0))
    return rows.withColumn("rg_new", flag).withColumn("cluster", F.sum("rg_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("rg_new")


def widened_clusters(clusters: DataFrame, on: Sequence[str], first: int = 3, by: float = 30.0) -> DataFrame:
    """Windows (t0, t1) of the first clusters, widened on both sides."""
    spans = clusters.where(F.col("cluster") < first).groupBy(*on, "cluster").agg(F.min("t_start").alias("lo"), F.max("t_end").alias("hi"))
    return spans.select(*on, "cluster", F.greatest(F.lit(0.0), F.col("lo") - by).alias("t0"), (F.col("hi") + by).alias("t1"))


def count_windows(rows: DataFrame, on: Sequence[str], order: Sequence[str], size: int = 10, step: int = 8, tail: str = "drop") -> DataFrame:
    """Rows with the number of each window of ``size`` rows, begun every ``step``, that holds them.

    ``tail='drop'``: windows that begin at 0, step, … below max(1, n - size + 1); ``'keep'``: a further
    one for the rows beyond the last full window.
    """
    by = Window.partitionBy(*on)
    n = rows.withColumns({"rg_i": F.row_number().over(by.orderBy(*order)) - 1, "rg_n": F.count("*").over(by)})
    full = F.greatest(F.lit(1), F.col("rg_n") - (size - 1))
    last = F.floor((full - 1) / step) if tail == "drop" else F.greatest(F.lit(0), F.ceil((F.col("rg_n") - size) / step))
    lo = F.greatest(F.lit(0), F.ceil((F.col("rg_i") - (size - 1)) / step)).cast("int")
    hi = F.least(F.floor(F.col("rg_i") / step), last).cast("int")
    return n.where(lo <= hi).withColumn("window_idx", F.explode(F.sequence(lo, hi))).drop("rg_n").withColumnRenamed("rg_i", "row_idx")


def uniform_subsample(rows: DataFrame, on: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """At most ``n`` rows of each group, at places floor(i * size / n)."""
    by = Window.partitionBy(*on)
    r = rows.withColumns({"rg_i": F.row_number().over(by.orderBy(*order)) - 1, "rg_n": F.count("*").over(by)})
    chosen = F.ceil(F.col("rg_i") * n / F.col("rg_n")) < F.ceil((F.col("rg_i") + 1) * n / F.col("rg_n"))
    return r.where((F.col("rg_n") <= n) | chosen).drop("rg_i", "rg_n")


def film_strip(rows: DataFrame, on: Sequence[str], t0: Column, t1: Column, time: str, score: str, order: str, slots: int) -> DataFrame:
    """The best row of each of equal half-open slots of a window; ties to the first."""
    slot = F.least(F.lit(slots - 1), F.floor((F.col(time) - t0) / ((t1 - t0) / slots))).cast("int")
    inside = rows.where((F.col(time) >= t0) & (F.col(time) < t1)).withColumn("slot", slot)
    w = Window.partitionBy(*on, "slot").orderBy(F.desc(score), order)
    return inside.withColumn("rg_n", F.row_number().over(w)).where("rg_n = 1").drop("rg_n")


def bucket_first(rows: DataFrame, on: Sequence[str], bucket: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each bucket of time."""
    keyed = rows.withColumn("bucket", bucket)
    return keyed.withColumn("rg_n", F.row_number().over(Window.partitionBy(*on, "bucket").orderBy(*order))).where("rg_n = 1").drop("rg_n")


def pick_keyframes(times: list[float], score: list[float], k: int, min_gap: float, max_gap: float) -> list[int]:
    """Places of the rows picked: greedily by score with a least gap, then so that no gap is too wide; ``times`` ascend."""
    order = sorted(range(len(times)), key=lambda i: (-score[i], i))
    chosen: list[float] = []  # times of the rows taken, sorted
    taken: set[int] = set()
    for i in order:
        if len(taken) >= k:
            break
        at = bisect_left(chosen, times[i])
        if (at == 0 or times[i] - chosen[at - 1] >= min_gap) and (at == len(chosen) or chosen[at] - times[i] >= min_gap):
            chosen.insert(at, times[i])
            taken.add(i)
    if not times:
        return []
    # the widest gap first; what lies between its ends is free, as the ends are neighbours among the taken
    edges = [times[0], *chosen, times[-1]]
    gaps = [(a - b, a, b) for a, b in zip(edges, edges[1:]) if b - a > max_gap]
    heapq.heapify(gaps)
    while gaps:
        _, a, b = heapq.heappop(gaps)
        lo, hi = bisect_right(times, a), bisect_left(times, b)
        if lo >= hi:
            continue
        middle = (a + b) / 2
        at = bisect_left(times, middle, lo, hi)
        near = [i for i in (bisect_left(times, times[at - 1], lo, hi) if at > lo else None, at if at < hi else None) if i is not None]
        found = min(near, key=lambda i: (abs(times[i] - middle), i))
        taken.add(found)
        for x, y in ((a, times[found]), (times[found], b)):
            if y - x > max_gap:
                heapq.heappush(gaps, (x - y, x, y))
    return sorted(taken)


def greedy_keyframes(frames: DataFrame, on: Sequence[str], time: str = "ts", score: str = "score", order: str = "ord", k: Column | int = 5, min_gap: float = 5.0, max_gap: float = 10.0) -> DataFrame:
    """Keyframes of each scene; each choice depends on those before, so a scene is one Pandas group."""
    rows = frames.withColumn("rg_k", F.lit(k) if isinstance(k, int) else k)

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([time, order], kind="stable").reset_index(drop=True)
        return g.iloc[pick_keyframes(g[time].tolist(), g[score].tolist(), int(g["rg_k"].iloc[0]), min_gap, max_gap)]

    return rows.groupBy(*on).applyInPandas(pick, rows.schema).drop("rg_k")


def spaced(frames: DataFrame, on: Sequence[str], time: str, order: str, interval: float, most: int) -> DataFrame:
    """Rows at least nine tenths of an interval after the last one accepted, ``most`` at most."""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([time, order], kind="stable")
        keep, last = [], None
        for i, t in enumerate(g[time].tolist()):
            if len(keep) < most and (last is None or t - last >= 0.9 * interval):
                keep.append(i)
                last = t
        return g.iloc[keep]

    return frames.groupBy(*on).applyInPandas(pick, frames.schema)
