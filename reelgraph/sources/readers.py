"""Sources: subtitles, graph JSON, questions, results, frames, audio and speech."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_caption, cue_seconds, time_range
from ..operators.aggregates import rms_per_second
from ..operators.windows import spaced
from ..schema import EDGES, NODES

SUBTITLE_SUFFIXES = (".srt", ".vtt", ".en.srt", ".en.vtt")
# Capitalised words of questions that are no names.
NO_NAMES = [
    "What", "When", "Where", "Which", "While", "After", "Before", "During", "Does", "Both", "None", "Their", "There", "They", "Then", "That", "This",
    "Show", "Video", "Following", "Mentioned", "According",
]


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SRT and VTT files: video_id, ord, start, end, text; what does not parse is skipped.

    A file is one record: blocks are found across its lines.  Cues that end before they start, and empty
    ones, are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.en)?\.(srt|vtt)$", 1).alias("video_id"), F.col("value"))
    return subtitle_blocks(files)


def subtitle_blocks(files: DataFrame) -> DataFrame:
    """Cues of whole files (video_id, value)."""
    blocks = files.select("video_id", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n\s*\n")).alias("ord", "block"))
    lines = blocks.withColumn("lines", F.split("block", "\n"))
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True)
    timed = lines.withColumn("at", at.cast("int")).where("at > 0").withColumn("times", F.split(F.get("lines", F.col("at") - 1), "-->"))
    text = clean_caption(F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), " "))
    cues = timed.select("video_id", F.col("ord").cast("bigint").alias("ord"), cue_seconds(F.try_element_at("times", F.lit(1))).alias("start"), cue_seconds(F.try_element_at("times", F.lit(2))).alias("end"), text.alias("text"))
    return cues.where("start is not null and end is not null and end >= start and text <> ''")


def subtitle_of(listing: DataFrame, videos: DataFrame) -> DataFrame:
    """The subtitle file of each video (path) out of a listing (path), by suffix in a fixed order."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    wanted = videos.select("path", F.posexplode(F.array(*[F.concat(stem("path"), F.lit(s)) for s in SUBTITLE_SUFFIXES])).alias("rg_n", "subtitle"))
    found = wanted.join(listing.select(F.col("path").alias("subtitle")).distinct(), "subtitle")
    return found.groupBy("path").agg(F.min_by("subtitle", "rg_n").alias("subtitle"))


def graph_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of graph documents with ``nodes`` and ``edges``: one JSON object per file, or per line."""
    fields = lambda ddl, drop: ", ".join(f"{c.split()[0]}:{c.split(' ', 1)[1]}" for c in _columns(ddl) if c.split()[0] not in drop)
    schema = f"video_id string, nodes array<struct<{fields(NODES, ('video_id', 'ord'))}>>, edges array<struct<{fields(EDGES, ('video_id', 'eord'))}>>"
    raw = spark.read.schema(schema).json(path, multiLine=not lines)
    nodes = raw.select("video_id", F.posexplode("nodes").alias("ord", "n")).select("video_id", F.col("ord").cast("bigint"), "n.*")
    edges = raw.select("video_id", F.posexplode("edges").alias("eord", "e")).select("video_id", F.col("eord").cast("bigint"), "e.*")
    order = lambda ddl: [c.split()[0] for c in _columns(ddl)]
    return nodes.select(*order(NODES)), edges.select(*order(EDGES))


def _columns(ddl: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return out


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of CSV files with quoted line breaks; all columns are text."""
    schema = "uid string, video_path string, type string, question string, question_type string, time_reference string, answer string"
    head = spark.read.csv(path, header=True, multiLine=True, escape='"')
    want = [c.split()[0] for c in schema.split(", ")]
    return head.select(*[F.col(c) if c in head.columns else F.lit(None).cast("string").alias(c) for c in want])


def time_references(questions_: DataFrame, video: str | Column) -> DataFrame:
    """Parsed time references of one video's questions."""
    q = questions_.where((F.col("video_path") == video) & (F.length(F.trim("time_reference")) > 0))
    return q.withColumn("r", time_range("time_reference")).where("r is not null").select("uid", "r.t0", "r.t1")


def proper_nouns(questions_: DataFrame, video: str | Column, stop: list[str] = NO_NAMES) -> DataFrame:
    """Capitalised words of one video's questions, without those that begin questions; sorted."""
    words = questions_.where(F.col("video_path") == video).select(F.explode(F.regexp_extract_all("question", F.lit(r"\b[A-Z][a-z]{2,15}\b"), F.lit(0))).alias("word"))
    return words.where(~F.col("word").isin(*stop)).distinct().orderBy("word")


def answered_ids(spark: SparkSession, path: str, key: str = "uid") -> DataFrame:
    """Ids of a log of JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(f"{key} string").json(path, mode="DROPMALFORMED").where(F.col(key).isNotNull()).select(key).distinct()


def results(spark: SparkSession, path: str) -> DataFrame:
    """Results of a log of JSON lines; a line that does not parse is an error."""
    schema = "uid string, video string, video_type string, question_types array<string>, time_reference string, predicted string, ground_truth string, correct boolean"
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def frame(frames: DataFrame, *ids: str) -> DataFrame:
    """Frames by id; the condition reaches the Parquet scan."""
    return frames.where(F.col("frame_id").isin(*ids))


def frame_keys(frames: DataFrame, contains: str | None = None) -> DataFrame:
    """Ids of the stored frames, those that hold a text if one is given; images are not read."""
    keys = frames.select("video_id", "frame_id")
    return (keys if contains is None else keys.where(F.contains("frame_id", F.lit(contains)))).orderBy("video_id", "frame_id")


def has_frame(ids: DataFrame, frames: DataFrame) -> DataFrame:
    """Which of the ids (video_id, frame_id) are stored."""
    stored = frames.select("video_id", "frame_id").distinct().withColumn("stored", F.lit(True))
    return ids.join(stored, ["video_id", "frame_id"], "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def data_uri(jpeg: str | Column = "jpeg") -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.base64(jpeg))


def coarse_grid(videos: DataFrame, target_fps: float = 1.0, most: int = 6000) -> DataFrame:
    """Times at which frames of each video (video_id, duration) are wanted; the rate falls where too many would be."""
    fps = F.least(F.lit(float(target_fps)), F.lit(float(most)) / F.greatest("duration", F.lit(1e-9)))
    n = F.floor(F.col("duration") * fps).cast("int")
    return videos.where("duration > 0").select("video_id", fps.alias("fps"), F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("i")).select("video_id", (F.col("i") / F.col("fps")).alias("ts"))


def window_frames(frames: DataFrame, t0: float, t1: float, most: int = 8, motion_rank: bool = False) -> DataFrame:
    """Frames of a window: a moment is widened by two seconds, short windows at three frames a second."""
    lo, hi = (t0 - 2.0, t1 + 2.0) if t1 - t0 < 1.0 else (t0, t1)
    span = max(hi - lo, 1e-9)
    interval = 1 / 3.0 if span <= 30 else span / most
    near = spaced(frames.where(F.col("ts").between(max(0.0, lo), hi)), ["video_id"], "ts", "ord", interval, 3 * most)
    by = Window.partitionBy("video_id")
    if motion_rank:
        return near.withColumn("rg_n", F.row_number().over(by.orderBy(F.desc("motion"), "ord"))).where(F.col("rg_n") <= most).drop("rg_n").orderBy("video_id", "ts")
    from ..operators.windows import uniform_subsample

    return uniform_subsample(near, ["video_id"], ["ts", "ord"], most).orderBy("video_id", "ts")


def audio_rms(samples: DataFrame) -> DataFrame:
    """Loudness of each second of each video, of samples (video_id, t, amplitude)."""
    return rms_per_second(samples, ["video_id"], "t", "amplitude")


def tables(spark: SparkSession, path: str, *names: str, videos: list[str] | None = None) -> dict[str, DataFrame]:
    """Graph tables that were written by ``writers.graph_tables``; of given videos only their folders are read."""
    from .writers import video_bucket

    out = {n: spark.read.parquet(posixpath.join(path, n)) for n in names}
    if videos is not None:
        buckets = [r[0] for r in spark.createDataFrame([(v,) for v in videos], "video_id string").select(video_bucket()).distinct().collect()]  # of the given ids
        out = {n: t.where(F.col("video_bucket").isin(*buckets) & F.col("video_id").isin(*videos)) for n, t in out.items()}
    return {n: t.drop("video_bucket") for n, t in out.items()}
