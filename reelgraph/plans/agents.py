"""Tool-calling and ReAct answering for a batch of questions, turn by turn.

The conversation is a table (qid, turn, role, text).  Each turn all open questions are put to the model at
once (a function from the conversation to (qid, text)); tool calls are parsed, each tool answers all its
calls in one plan, and the observations are appended as text.  A call that no tool serves is answered by an
error text.  Questions still open after the last turn are asked for a letter once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_letter, react_action, seconds, tool_calls
from ..operators.ranking import top_per_group
from ..schema import DETAIL_BUFFER
from .walking import held

V = ["video_id"]
AGENT_TURNS, REACT_TURNS, LIST_ROWS = 6, 8, 30
FORCE = "Answer now with a single letter."


def _lines(rows: DataFrame, line: Column, *order: str) -> DataFrame:
    """Lines of each call as one text."""
    packed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy("qid", "call").agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("text"))


def _line() -> Column:
    return F.concat(F.lit("["), F.format_string("%.0fs", "t_start"), F.lit("–"), F.format_string("%.0fs", "t_end"), F.lit("] "), F.regexp_replace("node_type", "Node$", ""), F.lit(": "), "label")


def list_episodes(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Episodes of each call's video in order of time; its first twenty scenes if it has none."""
    c = calls.select("qid", "call", *V)
    found = c.join(nodes.where("node_type = 'EpisodeNode'"), V)
    bare = c.join(found.select("qid", "call").distinct(), ["qid", "call"], "left_anti")
    scenes = top_per_group(bare.join(nodes.where("node_type = 'SceneNode'"), V), ["qid", "call"], 20, F.col("t_start"), F.col("node_id"))
    return _lines(found.unionByName(scenes), _line(), "t_start", "node_id")


def scene_detail(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """What overlaps each call's window (arguments t_start, t_end), five seconds wider, thirty rows at most."""
    at = lambda k: seconds(F.try_element_at("args", F.lit(k)))
    c = calls.select("qid", "call", *V, (at("t_start") - DETAIL_BUFFER).alias("lo"), (at("t_end") + DETAIL_BUFFER).alias("hi"))
    j = c.join(nodes.where(~F.col("node_type").isin("EpisodeNode", "VideoNode")), V).where("t_start <= hi and t_end >= lo")
    j = j.where((F.col("node_type") != "CharacterNode") | (F.col("t_end") - F.col("t_start") <= 10 * (F.col("hi") - F.col("lo"))))
    return _lines(top_per_group(j, ["qid", "call"], LIST_ROWS, F.col("t_start"), F.col("node_id")), _line(), "t_start", "node_id")


def search_graph(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose label holds words of each call's query, the most words first, in order of time."""
    query = F.array_distinct(F.filter(F.split(F.lower(F.try_element_at("args", F.lit("query"))), r"\W+"), lambda w: F.length(w) > 3))
    words = calls.select("qid", "call", *V, F.explode(query).alias("rg_w"))
    hits = words.join(nodes, V).where(F.contains(F.lower("label"), F.col("rg_w"))).groupBy("qid", "call", *V, "node_id").agg(F.count("*").alias("n"))
    best = top_per_group(hits, ["qid", "call"], LIST_ROWS, F.desc("n"), F.col("node_id")).join(nodes, [*V, "node_id"])
    return _lines(best, _line(), "t_start", "node_id")


def extract_frames(calls: DataFrame, frames: DataFrame, most: int = 8) -> DataFrame:
    """Times and ids of the frames of each call's window (arguments t_start, t_end, max_frames), at even places."""
    from .answering import live_frames

    at = lambda k: seconds(F.try_element_at("args", F.lit(k)))
    key = F.concat_ws("/", "qid", "call")
    asked = calls.select(key.alias("rg_key"), "qid", "call", *V, F.least(at("t_start"), at("t_end")).alias("t0"), F.greatest(at("t_start"), at("t_end")).alias("t1"), F.least(F.lit(most), F.coalesce(F.try_element_at("args", F.lit("max_frames")).try_cast("int"), F.lit(most))).alias("wanted"))
    found = live_frames(asked.select(F.col("rg_key").alias("qid"), *V, "t0", "t1", "wanted", F.lit(False).alias("motion_rank")), frames, F.col("wanted")).withColumnRenamed("qid", "rg_key")
    rows = found.join(asked.select("rg_key", "qid", "call"), "rg_key")
    return _lines(rows, F.concat(F.lit("[t="), F.format_string("%.1f", "ts"), F.lit("s] frame "), "frame_id"), "ts", "frame_id")


def tools(nodes: DataFrame, frames: DataFrame | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    served = {"list_episodes": lambda c: list_episodes(c, nodes), "search_graph": lambda c: search_graph(c, nodes), "get_scene_detail": lambda c: scene_detail(c, nodes)}
    return served if frames is None else {**served, "extract_frames": lambda c: extract_frames(c, frames)}


def calls_of(said: DataFrame, style: str) -> DataFrame:
    """Calls (qid, call, name, args) of what the model said; ReAct arguments are named by the tool's own order."""
    if style == "tools":
        return said.select("qid", F.posexplode(tool_calls("text")).alias("call", "x")).select("qid", "call", "x.name", "x.args")
    order = F.when(F.col("x.name").isin("get_scene_detail", "extract_frames"), F.array(F.lit("t_start"), F.lit("t_end"))).otherwise(F.array(F.lit("query")))
    given = F.slice("x.args", 1, F.size(order))
    return said.select("qid", F.lit(0).alias("call"), react_action("text").alias("x")).where("x is not null").select("qid", "call", "x.name", F.map_from_arrays(F.slice(order, 1, F.size(given)), given).alias("args"))


def run(questions: DataFrame, nodes: DataFrame, chat: Callable[[DataFrame], DataFrame], style: str = "tools", turns: int | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Answer questions (qid, video_id, question): qid, letter, turn; with ``frames``, frames can be asked for."""
    served = tools(nodes, frames)
    talk = held(questions.select("qid", F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")))
    live, done = questions.select("qid", *V), None
    limit = turns or (AGENT_TURNS if style == "tools" else REACT_TURNS)
    for turn in range(1, limit + 1):
        said = held(chat(talk.join(live.select("qid"), "qid", "left_semi")))
        calls = held(calls_of(said, style).join(live, "qid"))
        over = said.join(calls.select("qid").distinct(), "qid", "left_anti").select("qid", answer_letter("text").alias("letter")).where("letter <> ''").withColumn("turn", F.lit(turn))
        over = held(over)
        done = over if done is None else done.unionByName(over)
        live = held(live.join(over.select("qid"), "qid", "left_anti"))
        if not live.take(1):
            return done
        seen = [f(calls.where(F.col("name") == n)) for n, f in served.items()]
        text = seen[0]
        for part in seen[1:]:
            text = text.unionByName(part)
        answered = calls.join(text, ["qid", "call"], "left").withColumn("text", F.when(F.col("name").isin(*served), F.coalesce("text", F.lit("nothing found"))).otherwise(F.concat(F.lit("error: no tool "), "name")))
        lines = lambda df, role: df.select("qid", F.lit(turn).alias("turn"), F.lit(role).alias("role"), "text")
        talk = held(talk.unionByName(lines(said, "assistant")).unionByName(lines(answered, "tool")))
    asked = talk.join(live.select("qid"), "qid", "left_semi").unionByName(live.select("qid", F.lit(limit + 1).alias("turn"), F.lit("user").alias("role"), F.lit(FORCE).alias("text")))
    last = chat(asked).select("qid", answer_letter("text").alias("letter")).withColumn("turn", F.lit(limit + 1))
    return last if done is None else done.unionByName(last)
