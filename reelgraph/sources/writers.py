"""Sinks: graph tables and JSON, frames, answers, debug records and stage tables."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import deduplicated


#: Folders of a graph table.
VIDEO_BUCKETS = 256


def video_bucket(video="video_id"):
    return F.pmod(F.xxhash64(video), F.lit(VIDEO_BUCKETS)).cast("int")


def graph_tables(nodes: DataFrame, edges: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """Nodes and edges in ``VIDEO_BUCKETS`` folders by a hash of the video, sorted by video and time inside
    files, so that the folders do not grow with the videos and windows skip row groups.

    Of edges with the same end points and type the first stays; shifts are told apart by their time.
    """
    def put(rows: DataFrame, name: str, *order: str) -> None:
        # a long video is spread over several tasks by its rows' own hash; each task writes to few folders
        keyed = rows.withColumn("video_bucket", video_bucket()).repartition("video_bucket", F.pmod(F.xxhash64(order[-1]), F.lit(8)))
        keyed.sortWithinPartitions("video_bucket", *order).write.partitionBy("video_bucket").mode("overwrite").parquet(posixpath.join(path, name))

    put(nodes, "nodes", "video_id", "t_start", "node_id")
    put(deduplicated(edges, ["video_id"], disc=True), "edges", "video_id", "src", "dst")
    if vectors is not None:
        put(vectors, "embeddings", "video_id", "node_id")


def vector_table(vectors: DataFrame, path: str) -> None:
    """The vectors of nodes (video_id, node_id, embedding) apart from the nodes, in the folders of their videos."""
    keyed = vectors.withColumn("video_bucket", video_bucket()).repartition("video_bucket", F.pmod(F.xxhash64("node_id"), F.lit(8)))
    keyed.sortWithinPartitions("video_bucket", "video_id", "node_id").write.partitionBy("video_bucket").mode("overwrite").parquet(path)


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per video.  A video's graph becomes one row, as the format wants it."""
    n = nodes.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(*[c for c in nodes.columns if c not in ("video_id", "ord")])).alias("x")))).alias("n"))
    e = deduplicated(edges, ["video_id"], disc=True)
    e = e.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("eord", "src", "dst", F.to_json(F.struct(*[c for c in edges.columns if c not in ("video_id", "eord")])).alias("x")))).alias("e"))
    node_json = F.concat(F.lit("["), F.array_join(F.transform("n", lambda s: s["x"]), ","), F.lit("]"))
    edge_json = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("e", F.expr("array()").cast(e.schema["e"].dataType)), lambda s: s["x"]), ","), F.lit("]"))
    j = n.select("video_id", node_json.alias("nj")).join(e.select("video_id", edge_json.alias("ej")), "video_id", "left")
    name = F.regexp_extract(F.to_json(F.struct("video_id")), r"^\{(.*)\}$", 1)
    return j.select(F.concat(F.lit("{"), name, F.lit(',"nodes":'), "nj", F.lit(',"edges":'), F.coalesce("ej", F.lit("[]")), F.lit("}")).alias("value"))


def frames(new: DataFrame, path: str, spark: SparkSession) -> None:
    """Append frames that are not stored yet; frames without an image are skipped."""
    rows = new.where("jpeg is not null").dropDuplicates(["video_id", "frame_id"])
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("video_id", "frame_id"), ["video_id", "frame_id"], "left_anti")
    rows.write.mode("append").partitionBy("video_id").parquet(path)


def answers(new: DataFrame, path: str, spark: SparkSession, key: str = "uid") -> None:
    """Append answers as JSON lines, each id once, so that a run may be repeated."""
    rows = new.dropDuplicates([key])
    if exists(spark, path):
        rows = rows.join(spark.read.schema(f"{key} string").json(path).select(key), key, "left_anti")
    rows.write.mode("append").json(path)


def debug_records(rows: DataFrame, path: str, stage: str) -> None:
    rows.withColumn("stage", F.lit(stage)).withColumn("written", F.current_timestamp()).write.mode("append").partitionBy("stage").parquet(path)


def metrics(rows: DataFrame, path: str) -> None:
    rows.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage: read if it was finished before, else made, written and read."""
    if not exists(spark, posixpath.join(path, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
