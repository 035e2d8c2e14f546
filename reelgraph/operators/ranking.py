"""Top-k, budgets and rank-then-order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, on: Sequence[str], k: int | Column, *order: Column, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; the order must end in something unique."""
    name = rank or "rg_rank"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def budget_prune(nodes: DataFrame, on: Sequence[str], is_seed: Column, most: int, confidence: str = "confidence", node: str = "node_id") -> DataFrame:
    """All seeds, then the most confident others up to ``most`` rows of each group.

    Seeds are counted and the others ranked apart, so that Spark limits the others before the shuffle.
    """
    marked = nodes.withColumn("rg_seed", F.coalesce(is_seed, F.lit(False)))
    seeds, others = marked.where("rg_seed"), marked.where("not rg_seed")
    if on:
        best = top_per_group(others, on, most, F.desc(confidence), F.col(node), rank="rg_n")
        taken = seeds.groupBy(*[F.col(c).alias(f"rg_{c}") for c in on]).agg(F.count("*").alias("rg_taken"))
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"rg_{c}"))
        best = best.join(taken, same, "left").drop(*[f"rg_{c}" for c in on])
    else:  # one group: its best rows are found without sorting all of it in one task
        best = others.orderBy(F.desc(confidence), node).limit(most).withColumn("rg_n", F.row_number().over(Window.orderBy(F.desc(confidence), node)))
        best = best.crossJoin(F.broadcast(seeds.agg(F.count("*").alias("rg_taken"))))  # one row
    best = best.where(F.col("rg_n") + F.coalesce("rg_taken", F.lit(0)) <= most)
    return seeds.drop("rg_seed").unionByName(best.drop("rg_seed", "rg_n", "rg_taken"))


def ranked_then_by_time(rows: DataFrame, on: Sequence[str], most: int, *rank: Column, time: str = "t_start", tie: str = "node_id") -> DataFrame:
    """The best rows of each group, numbered in order of time: rank, cap, then sort; never the reverse."""
    best = top_per_group(rows, on, most, *rank)
    return best.withColumn("position", F.row_number().over(Window.partitionBy(*on).orderBy(time, tie)))


def nearest_in_time(nodes: DataFrame, t0: float, t1: float, k: int = 20) -> DataFrame:
    """The rows whose start is nearest to a window's middle."""
    return nodes.orderBy(F.abs(F.col("t_start") - (t0 + t1) / 2), "node_id").limit(k)


def majority(votes: DataFrame, on: Sequence[str], answer: str, order: str, error: str = "ERROR") -> DataFrame:
    """The most frequent answer of each group, ties to the first seen; ERROR and empty ones do not count."""
    valid = F.col(answer).isNotNull() & ~F.col(answer).isin("", error)
    counted = votes.where(valid).groupBy(*on, answer).agg(F.count("*").alias("rg_c"), F.min(order).alias("rg_f"))
    best = top_per_group(counted, on, 1, F.desc("rg_c"), F.col("rg_f")).select(*on, F.col(answer).alias("rg_a"))
    return votes.select(*on).distinct().join(best, list(on), "left").select(*on, F.coalesce("rg_a", F.lit(error)).alias(answer))


def dominant(counts: DataFrame, on: Sequence[str], candidate: str, score: str) -> DataFrame:
    """The best candidate of each group, if it is alone or has twice the score of the second; Spark limits a group to two before the shuffle."""
    w = Window.partitionBy(*on).orderBy(F.desc(score), candidate)
    two = top_per_group(counts, on, 2, F.desc(score), F.col(candidate))
    r = two.withColumns({"rg_n": F.row_number().over(w), "rg_second": F.lead(score).over(w)}).where("rg_n = 1")
    return r.where(F.col("rg_second").isNull() | (F.col(score) >= 2 * F.greatest(F.lit(1), F.col("rg_second")))).drop("rg_n", "rg_second")
