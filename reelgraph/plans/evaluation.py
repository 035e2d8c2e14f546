"""Answers against the truth: resuming, joining and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_literal
from ..operators.aggregates import accuracy, accuracy_by_type


def unanswered(questions: DataFrame, answered: DataFrame, key: str = "uid") -> DataFrame:
    """Questions without an answer yet; what makes a run resumable."""
    return questions.join(answered.select(key).distinct(), key, "left_anti")


def scored(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Results: predicted against true letter, with question types as an array."""
    q = questions.select("uid", F.col("video_path").alias("video"), F.coalesce("type", F.lit("unknown")).alias("video_type"), list_literal("question_type").alias("question_types"), "time_reference", F.col("answer").alias("ground_truth"))
    return q.join(answers.select("uid", F.col("answer").alias("predicted")), "uid").withColumn("correct", F.upper(F.trim("predicted")) == F.upper(F.trim("ground_truth")))


def metrics(results: DataFrame) -> DataFrame:
    """Accuracy overall, by video, by video type and by question type, in one table."""
    part = lambda scope, df, key: df.select(F.lit(scope).alias("scope"), F.col(key).alias("key"), "total", "correct", "accuracy")
    out = part("overall", accuracy(results).withColumn("key", F.lit("all")), "key")
    for scope, column in (("video", "video"), ("video_type", "video_type")):
        out = out.unionByName(part(scope, accuracy(results, F.coalesce(F.col(column), F.lit("unknown"))), "key"))
    return out.unionByName(part("question_type", accuracy_by_type(results), "question_type"))
