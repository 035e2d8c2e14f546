"""Roll-ups over nodes, appearances, votes and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import location_key


def location_rollup(scenes: DataFrame, on: Sequence[str], location: str = "location", start: str = "t_start", end: str = "t_end", order: str = "ord") -> DataFrame:
    """Time extent and first spelling of each location; empty and unknown ones are left out."""
    keyed = scenes.withColumn("key", location_key(location)).where("key is not null and key not in ('', 'unknown')")
    return keyed.groupBy(*on, "key").agg(F.min(start).alias("t_start"), F.max(end).alias("t_end"), F.min_by(F.trim(location), order).alias("label"), F.count("*").alias("scenes"))


def ordered_distinct(rows: DataFrame, on: Sequence[str], value: str, order: str, out: str) -> DataFrame:
    """Distinct values of each group in order of their first appearance."""
    firsts = rows.groupBy(*on, value).agg(F.min(order).alias("rg_o"))
    packed = F.array_sort(F.collect_list(F.struct("rg_o", F.col(value).alias("v"))))
    return firsts.groupBy(*on).agg(F.transform(packed, lambda x: x["v"]).alias(out))


def entity_extent(mentions: DataFrame, on: Sequence[str], time: str = "timestamp", description: str = "description", order: str = "ord") -> DataFrame:
    """First and last mention, number of mentions and the longest description (first on ties)."""
    return mentions.groupBy(*on).agg(
        F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.count("*").alias("mentions"), F.max_by(description, F.struct(F.length(description), -F.col(order))).alias("canonical_description")
    )


def repeated_occurrences(nodes: DataFrame, on: Sequence[str], entity: str = "entity_id", time: str = "t_start") -> DataFrame:
    """Does any entity of a group occur at two or more distinct times, to a tenth of a second?"""
    times = nodes.where(F.col(entity).isNotNull()).groupBy(*on, entity).agg(F.countDistinct(F.bround(time, 1)).alias("n"))
    return times.groupBy(*on).agg(F.bool_or(F.col("n") >= 2).alias("temporal_occurrences"))


def peaks(rows: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Rows above mean plus two population deviations of their group, with the threshold."""
    stats = rows.groupBy(*on).agg((F.avg(value) + 2 * F.stddev_pop(value)).alias("threshold"))
    joined = rows.join(stats, list(on)) if on else rows.crossJoin(F.broadcast(stats))  # one row
    return joined.where((F.col("threshold") > 0) & (F.col(value) > F.col("threshold")))


def max_normalized(rows: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    top = rows.groupBy(*on).agg(F.max(value).alias("rg_top"))
    joined = rows.join(top, list(on)) if on else rows.crossJoin(F.broadcast(top))
    return joined.withColumn(value, F.when(F.col("rg_top") > 0, F.col(value) / F.col("rg_top")).otherwise(F.lit(0.0))).drop("rg_top")


def rms_per_second(samples: DataFrame, on: Sequence[str], time: str, value: str) -> DataFrame:
    """Root mean square per second, over the greatest of the group."""
    per = samples.groupBy(*on, F.floor(time).cast("int").alias("sec")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return max_normalized(per, on, "rms")


def accuracy(results: DataFrame, by: Column | None = None, name: str = "key", correct: str = "correct") -> DataFrame:
    """Rows, correct ones and their share, overall or by a column; an array counts for each of its items."""
    measures = (F.count("*").alias("total"), F.count_if(correct).alias("correct"), F.avg(F.col(correct).cast("int")).alias("accuracy"))
    return results.agg(*measures) if by is None else results.groupBy(by.alias(name)).agg(*measures)


def accuracy_by_type(results: DataFrame, types: str = "question_types") -> DataFrame:
    return accuracy(results.withColumn("rg_type", F.explode(types)), F.col("rg_type"), "question_type").orderBy(F.desc("total"), "question_type")


def completeness(questions: DataFrame, answered: DataFrame, on: str, key: str) -> DataFrame:
    """Are all questions of a group answered?"""
    seen = answered.select(key).distinct().withColumn("rg_seen", F.lit(True))
    return questions.join(seen, key, "left").groupBy(on).agg(F.count("*").alias("total"), F.count("rg_seen").alias("answered"), F.bool_and(F.coalesce("rg_seen", F.lit(False))).alias("complete"))


def merged_windows(records: DataFrame, on: Sequence[str], items: str, text: str, window: str) -> DataFrame:
    """Items of all windows of a scene, the first of each folded text; items without a text all stay."""
    flat = records.select(*on, window, F.posexplode(items).alias("rg_pos", "item"))
    key = F.lower(F.trim(F.col(f"item.{text}")))
    flat = flat.withColumn("rg_key", F.when(F.length(F.coalesce(key, F.lit(""))) > 0, key).otherwise(F.concat(F.lit("\0"), F.col(window), F.lit("\0"), F.col("rg_pos"))))
    firsts = flat.groupBy(*on, "rg_key").agg(F.min(F.struct(window, "rg_pos", "item")).alias("x"))
    return firsts.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias(items))
