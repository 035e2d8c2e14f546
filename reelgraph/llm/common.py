"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_path, drop_scratch, scratch_path, shared_dir  # noqa: F401  for the operators

#: Rows that a Python worker turns into Python objects at once.
SLICE_ROWS = 1024
#: Characters after which such a slice ends early, so that long texts do not add up.
SLICE_CHARS = 1_000_000


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is looked up again on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def prepare_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed, and bound their batches of texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage with a table in the shared folder; it survives the loss of executors.

    The table stays until ``forget`` or ``drop_scratch``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._rg_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Drop materialized tables that nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t._rg_path)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut batches into pieces of bounded text; null texts come as empty strings."""
    import pyarrow.compute as pc

    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = 0
        while start < len(sizes):
            end, total = start, 0
            while end < len(sizes) and end - start < SLICE_ROWS and (end == start or total + sizes[end] <= SLICE_CHARS):
                total += sizes[end]
                end += 1
            part = batch.slice(start, end - start)
            yield part, [t or "" for t in column.slice(start, end - start).to_pylist()]
            start = end


_HELD: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What an operator keeps in this worker from task to task; what other operators kept is dropped."""
    for name, kept in _HELD.items():
        if name != operator:
            kept.clear()
    return _HELD.setdefault(operator, {})


def id_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def word_count(column) -> F.Column:
    """How many runs of bytes other than blank, tab and line ends a text has; null counts as empty."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
