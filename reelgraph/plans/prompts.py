"""Prompts as tables, and the contracts of the functions that answer them.

A prompt is a row: qid, a system text, a user text, and the frames to show.  An encoder is a function from a
column of texts or images to a column of unit vectors; it is made once in each Python worker, when a batch
first needs it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import induced
from ..operators.intervals import containing_join, count_inside
from ..operators.ranking import top_per_group
from ..schema import CONTEXT_CHARS
from . import serialization, walking
from .answering import LETTER_ONLY

V = ["video_id"]
CONTROLLER = (
    "You walk a video's knowledge graph to gather what an answer needs. Choose one action and reply with JSON: EXPAND (relation family), ZOOM (node_id), "
    "DISCRIMINATE (option), RECALL (query), BUILD (look at the video anew), ANSWER (letter and the node ids it rests on)."
)
SCENE = "Describe these frames as JSON: scene_label, location, objects, actions, characters, ocr_text, state_changes, spatial_relations."
CAUSAL_SYSTEM = "Name cause and effect among these events as JSON: a list of cause, effect, relation (CAUSES, ENABLES, PREVENTS or MOTIVATES), confidence, reasoning."
CAUSAL_EVENTS = 300


def capped(text: Column, most: int = CONTEXT_CHARS) -> Column:
    """A text that fits a prompt; what is cut off is said."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n...[context cut]"))).otherwise(text)


def encoder(make: Callable[[], Callable[[list], np.ndarray]]) -> Callable[[Column], Column]:
    """A column function of an encoder: ``make()`` gives the encoder of a worker, once; vectors come out of unit length."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for batch in batches:
            model = model or make()
            given = [x for x in batch if x is not None]
            rows = np.asarray(model(given), np.float32) if given else np.empty((0, 1), np.float32)
            rows = iter(rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12))
            yield pd.Series([None if x is None else next(rows) for x in batch], dtype=object)

    return encode


def with_frames(prompts: DataFrame, frames: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """Prompts with the frames of each walk that are still shown (``walking.kept_frames``), the older ones as text."""
    shown = frames.where("not archived").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ts", "frame_id"))).alias("frames"))
    out = prompts.join(shown, "qid", "left")
    if archived is None:
        return out
    line = F.concat(F.lit("["), F.format_string("%.0fs", "ts"), F.lit("] "), "text")
    old = archived.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", line.alias("line")))), lambda x: x["line"]), "\n").alias("old"))
    return out.join(old, "qid", "left").withColumn("user", F.when(F.col("old").isNotNull(), F.concat("user", F.lit("\n\n## Frames seen before\n"), "old")).otherwise(F.col("user"))).drop("old")


def archived_texts(frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts that stand in for the frames a walk no longer shows."""
    return walking.frame_texts(frames.where("archived"), nodes)


def _contexts(questions: DataFrame, chosen: DataFrame, edges: DataFrame, with_edges: bool) -> DataFrame:
    inner = induced(chosen.select("qid", *V).distinct().join(edges, V), chosen, ["qid"])
    return serialization.serialize(questions, chosen, inner, include_edges=with_edges).select("qid", capped(F.col("context")).alias("context"))


def answerer_prompts(questions: DataFrame, chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """The prompt that asks for an answer from the chosen nodes (with qid) of each question."""
    return _contexts(questions, chosen, edges, False).select("qid", F.lit(LETTER_ONLY).alias("system"), F.col("context").alias("user"))


def controller_prompts(questions: DataFrame, chosen: DataFrame, edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The prompt that asks for the next action: the subgraph with its edges, what the walk lacks, and its frontier.

    ``verdicts``: qid, hop, coverage, gaps.
    """
    text = _contexts(questions, chosen, edges, True)
    last = chosen.groupBy("qid").agg(F.max("hop").alias("hop"))
    ring = top_per_group(chosen.join(last, ["qid", "hop"]), ["qid"], 20, F.desc("confidence"), F.col("node_id"))
    line = F.concat("node_id", F.lit(" "), F.regexp_replace("node_type", "Node$", ""), F.lit(": "), F.left("label", F.lit(80)))
    frontier = ring.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_start", "node_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("frontier"))
    j = text.join(verdicts.select("qid", F.col("hop").alias("step"), "coverage", "gaps"), "qid", "left").join(frontier, "qid", "left")
    state = F.concat(F.lit("\n\n## Walk\nhop "), F.coalesce(F.col("step").cast("string"), F.lit("0")), F.lit(", coverage "), F.format_string("%.2f", F.coalesce("coverage", F.lit(0.0))), F.lit("\nlacking: "), F.coalesce(F.expr("nullif(array_join(gaps, ', '), '')"), F.lit("nothing")), F.lit("\n\n## Frontier\n"), F.coalesce("frontier", F.lit("")))
    return j.select("qid", F.lit(CONTROLLER).alias("system"), F.concat("context", state).alias("user"))


def causal_requests(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """The prompt of each episode: its first three hundred events in order of time.

    ``events``: video_id, episode, node_id, node_type, label, t_start.
    """
    first = top_per_group(events, ["video_id", "episode"], CAUSAL_EVENTS, F.col("t_start"), F.col("node_id"))
    line = F.concat(F.lit("["), F.format_string("%.1fs", "t_start"), F.lit("] "), F.regexp_replace("node_type", "Node$", ""), F.lit(": "), "label")
    text = first.groupBy("video_id", "episode").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_start", "node_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("n_events"))
    j = episodes.join(text, ["video_id", "episode"])
    return j.select("video_id", "episode", F.lit(CAUSAL_SYSTEM).alias("system"), F.concat(F.lit("Episode: "), "label", F.lit("\n"), "body").alias("user"), "n_events")


def scene_requests(windows: DataFrame, frames: DataFrame, hints: DataFrame | None = None, listed: bool = True) -> DataFrame:
    """The prompt of each frame window (video_id, win_id, t_start, t_end): its frames in order, and what was said there.

    Not ``listed``, the frames are only counted (``n_frames``), without pairing them with their windows.
    """
    spans = windows.select(*V, "win_id", F.col("t_start").alias("b_t0"), F.col("t_end").alias("b_t1"))
    points = frames.select(*V, "frame_id", "ts", F.col("ts").alias("a_t"))
    if listed:
        shown = containing_join(points, spans, V).groupBy("video_id", "win_id").agg(F.array_sort(F.collect_list(F.struct("ts", "frame_id"))).alias("frames"))
    else:
        shown = count_inside(spans, points, ["win_id"], V, out="n_frames")
    out = windows.select("video_id", "win_id", "t_start", "t_end").join(shown, ["video_id", "win_id"])
    user = F.concat(F.lit("Frames from "), F.format_string("%.1f", "t_start"), F.lit("s to "), F.format_string("%.1f", "t_end"), F.lit("s."))
    if hints is not None:  # video_id, win_id, said
        out = out.join(hints, ["video_id", "win_id"], "left")
        user = F.concat(user, F.coalesce(F.concat(F.lit("\nSaid: "), "said"), F.lit("")))
    return out.select("video_id", "win_id", F.lit(SCENE).alias("system"), user.alias("user"), "frames" if listed else "n_frames")
