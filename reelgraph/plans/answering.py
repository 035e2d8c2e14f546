"""Answering a batch of questions: in one shot from an activated subgraph, or in two stages from a plan.

All questions run at once; what the model says comes from functions from a table of prompts to (qid, text).
A prompt has a system text, a user text and frames in order of time; images stay in the frame table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_letter, list_literal, time_range
from ..functions.vectors import tail_extended
from ..operators.graph import induced
from ..operators.ranking import top_per_group
from ..operators.windows import count_windows, film_strip
from ..schema import PLAN
from ..shared import shared_dir
from . import activation, agents, context, serialization

V = ["video_id"]
ONE_SHOT_FRAMES, LIVE_SPAN, HOLE = 8, 90.0, 8.0
IMAGES, OVERLAP, PLAN_QUERY = 10, 2, 60
#: Frames of questions that need a dense look, and of others; their types.
DENSE_FRAMES, PLAIN_FRAMES = 14, 8
DENSE_TYPES = ("entity recognition", "key information retrieval", "event understanding", "temporal grounding")
VISUAL_TYPES = ("ClipNode", "ObjectNode", "StateChangeNode", "SceneNode")

LETTER_ONLY = "Answer the multiple-choice question about the video from the evidence given. Name one letter, A, B, C or D, on a line of its own."
IN_WORDS = "Answer the question about the video from the evidence given, and name the times it rests on."
PLANNER = "Choose what to look up in the video's graph before the question is answered. Reply with JSON: windows (t_start, t_end in seconds), search_queries, needs_frames, reasoning."


def graph_counts(nodes: DataFrame, edges: DataFrame, on: Sequence[str] = ("video_id",)) -> DataFrame:
    """Nodes, edges, keyframes and scenes of each graph."""
    n = nodes.groupBy(*on).agg(F.count("*").alias("n_nodes"), F.countDistinct("keyframe_id").alias("n_keyframes"), F.count_if(F.col("node_type") == "SceneNode").alias("n_scenes"))
    e = edges.groupBy(*on).agg(F.count("*").alias("n_edges"))
    return n.join(e, list(on), "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0).cast("bigint")))


def visual_order(nodes: DataFrame, on: Sequence[str], most: int) -> DataFrame:
    """The keyframes to show of each group: those sampled for questions (``qs_``) first, then by confidence."""
    shown = nodes.where("keyframe_id is not null")
    return top_per_group(shown, on, most, F.when(F.col("keyframe_id").startswith("qs_"), 0).otherwise(1), F.desc("confidence"), F.col("ord"), rank="shown")


def strip_with_top_up(nodes: DataFrame, on: Sequence[str], t0: Column, t1: Column, most: int) -> DataFrame:
    """The best keyframe of each of ``most`` equal slots of a window; empty slots are made up by ``qs_`` frames."""
    shown = nodes.where("keyframe_id is not null").withColumns({"rg_t0": t0, "rg_t1": t1})
    strip = film_strip(shown, on, F.col("rg_t0"), F.col("rg_t1"), "t_start", "confidence", "ord", most)
    taken = strip.groupBy(*on).agg(F.count("*").alias("rg_taken"))
    spare = shown.where(F.col("keyframe_id").startswith("qs_")).join(strip.select(*on, "node_id"), [*on, "node_id"], "left_anti")
    spare = top_per_group(spare, on, most, F.col("ord"), F.col("node_id"), rank="rg_n").join(taken, list(on), "left").where(F.col("rg_n") + F.coalesce("rg_taken", F.lit(0)) <= most)
    return strip.drop("slot", "rg_t0", "rg_t1").unionByName(spare.drop("rg_n", "rg_taken", "rg_t0", "rg_t1"))


def live_frames(wanted: DataFrame, frames: DataFrame, most: Column) -> DataFrame:
    """Frames of each question's window (qid, video_id, t0, t1, motion_rank): qid, ts, frame_id.

    A moment is widened by two seconds on both sides.  Of too many, the liveliest stay where ``motion_rank``
    says so, else those at even places.
    """
    point = F.col("t1") - F.col("t0") < 1.0
    w = wanted.withColumns({"lo": F.greatest(F.lit(0.0), F.when(point, F.col("t0") - 2.0).otherwise(F.col("t0"))), "hi": F.when(point, F.col("t1") + 2.0).otherwise(F.col("t1")), "rg_most": most})
    j = w.join(frames, V).where(F.col("ts").between(F.col("lo"), F.col("hi")))
    by = Window.partitionBy("qid")
    j = j.withColumns({"rg_i": F.row_number().over(by.orderBy("ts", "frame_id")) - 1, "rg_n": F.count("*").over(by), "rg_m": F.row_number().over(by.orderBy(F.desc("motion"), "ts", "frame_id"))})
    even = (F.col("rg_n") <= F.col("rg_most")) | (F.ceil(F.col("rg_i") * F.col("rg_most") / F.col("rg_n")) < F.ceil((F.col("rg_i") + 1) * F.col("rg_most") / F.col("rg_n")))
    return j.where(F.when(F.coalesce("motion_rank", F.lit(False)), F.col("rg_m") <= F.col("rg_most")).otherwise(even)).select("qid", *V, "ts", "frame_id")


def parsed_questions(questions: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """Questions with intents, types and the reference window, earlier end first."""
    q = activation.classify_intent(questions, intents).withColumns({"types": list_literal("question_type"), "rg_r": time_range("time_reference")})
    return q.withColumns({"ref_t0": F.col("rg_r.t0"), "ref_t1": F.col("rg_r.t1")}).drop("rg_r")


def one_shot_prompts(
    questions: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, frames: DataFrame, intents: DataFrame | None = None, most: int = ONE_SHOT_FRAMES, mcq: bool = True
) -> DataFrame:
    """The prompt of each question (qid, video_id, question, question_type, time_reference, video_type, embedding).

    With a time reference the window is activated, without one what is similar.  Windows up to ninety
    seconds, and those in which the graph has a hole, show frames of the video itself; wider ones a film
    strip of the graph's keyframes; questions without a window the keyframes by rank.
    """
    shared_dir(questions.sparkSession)
    q = parsed_questions(questions, intents).checkpoint()
    timed, free = q.where("ref_t0 is not null"), q.where("ref_t0 is null")
    seeds = activation.seeds_by_similarity(free, vectors)
    active = activation.activate_references(timed, nodes, edges).unionByName(activation.activate(free, seeds, nodes, edges), allowMissingColumns=True).checkpoint()
    least = activation.least_precision(active, ["qid"])
    span = F.col("ref_t1") - F.col("ref_t0")
    q = q.join(least, "qid", "left").withColumn("live", F.coalesce((span <= LIVE_SPAN) | (F.col("least_precision") > HOLE), F.lit(False)))
    stored = active.where("keyframe_id is not null").join(q.where("not live").select("qid", "ref_t0", "ref_t1"), "qid")
    counted = stored.withColumn("rg_c", F.count("*").over(Window.partitionBy("qid")))
    wide = (F.col("ref_t1") - F.col("ref_t0") > LIVE_SPAN) & (F.col("rg_c") > most)
    strip = strip_with_top_up(counted.where(wide), ["qid"], F.col("ref_t0"), F.col("ref_t1"), most)
    ranked = visual_order(counted.where(~F.coalesce(wide, F.lit(False))), ["qid"], most)
    kept = strip.select("qid", *V, "keyframe_id").unionByName(ranked.select("qid", *V, "keyframe_id")).distinct()
    kept = kept.join(frames.select(*V, F.col("frame_id").alias("keyframe_id"), "ts"), [*V, "keyframe_id"]).select("qid", *V, "ts", F.col("keyframe_id").alias("frame_id"))
    bare = q.where("ref_t0 is not null").join(kept.select("qid").distinct(), "qid", "left_anti")  # live ones, and those without a stored frame
    window = bare.select("qid", *V, F.col("ref_t0").alias("t0"), F.col("ref_t1").alias("t1"), F.col("video_type").isin("sport", "live").alias("motion_rank"))
    shown = kept.unionByName(live_frames(window, frames, F.lit(most))).checkpoint()
    seen = shown.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "frame_id"))), lambda x: x).alias("frames"))
    q = q.join(seen, "qid", "left").withColumn("visual_provided", F.size(F.coalesce("frames", F.array().cast("array<struct<ts:double,frame_id:string>>"))) > 0)
    inner = induced(active.select("qid", *V).distinct().join(edges, V), active, ["qid"])
    text = serialization.serialize(q, active, inner)
    sizes = active.groupBy("qid").agg(F.count("*").alias("subgraph_size"))
    return q.join(text, "qid").join(sizes, "qid", "left").select("qid", *V, "intents", F.lit(LETTER_ONLY if mcq else IN_WORDS).alias("system"), F.col("context").alias("user"), "frames", F.coalesce("subgraph_size", F.lit(0).cast("bigint")).alias("subgraph_size"))


def answer_one_shot(prompts: DataFrame, chat: Callable[[DataFrame], DataFrame], mcq: bool = True) -> DataFrame:
    """One call for all questions: qid, answer, intents, subgraph_size."""
    said = chat(prompts)
    answer = answer_letter("text") if mcq else F.trim("text")
    return prompts.select("qid", "intents", "subgraph_size").join(said.select("qid", answer.alias("answer")), "qid", "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def planner_prompts(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """The planner's prompt: episodes, types and reference window, question."""
    calls = questions.select("qid", *V).withColumn("call", F.lit(0))
    listed = agents.list_episodes(calls, nodes).select("qid", F.col("text").alias("episodes"))
    q = questions.join(listed, "qid", "left").withColumn("rg_r", time_range("time_reference"))
    types = F.array_join(list_literal("question_type"), ", ")
    kind = F.when(F.length(types) > 0, F.concat(F.lit("[Question type: "), types, F.lit("]\n")))
    seconds = F.when(F.col("rg_r").isNotNull(), F.concat(F.lit(" (= "), F.col("rg_r.t0").cast("bigint"), F.lit("s–"), F.col("rg_r.t1").cast("bigint"), F.lit("s from the start)")))
    at = F.when(F.length(F.trim("time_reference")) > 0, F.concat(F.lit("[Time reference: "), "time_reference", F.coalesce(seconds, F.lit("")), F.lit("]\n")))
    user = F.concat(F.coalesce("episodes", F.lit("")), F.lit("\n\n"), F.coalesce(kind, F.lit("")), F.coalesce(at, F.lit("")), F.lit("Question: "), "question")
    return q.select("qid", *V, F.lit(PLANNER).alias("system"), user.alias("user"))


def plans(said: DataFrame, questions: DataFrame) -> DataFrame:
    """Plans of all questions; what does not parse becomes a search for the question's first words."""
    p = said.select("qid", F.from_json(F.trim("text"), PLAN).alias("p")).where("p.windows is not null or p.search_queries is not null")
    j = questions.select("qid", *V, "question").join(p, "qid", "left")
    none = F.array().cast("array<struct<t_start:double,t_end:double>>")
    queries = F.when(F.col("p").isNull(), F.array(F.left("question", F.lit(PLAN_QUERY)))).otherwise(F.coalesce("p.search_queries", F.array().cast("array<string>")))
    return j.select("qid", *V, F.coalesce("p.windows", none).alias("windows"), queries.alias("search_queries"), F.coalesce("p.needs_frames", F.lit(False)).alias("needs_frames"), F.coalesce("p.reasoning", F.lit("")).alias("reasoning"))


def plan_hits(plans_: DataFrame, questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that the plan's queries and the question's options find by words: qid, video_id, node_id, score."""
    from ..functions.text import options

    asked = plans_.select("qid", *V, F.explode("search_queries").alias("query"))
    named = questions.select("qid", *V, F.explode(options("question")).alias("letter", "query")).where(F.length("query") > 3).drop("letter")
    words = asked.unionByName(named).select("qid", *V, F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"\W+"), lambda w: F.length(w) > 3))).alias("rg_w")).distinct()
    hits = words.join(nodes.select(*V, "node_id", F.lower("label").alias("rg_l")), V).where(F.contains("rg_l", F.col("rg_w")))
    return hits.groupBy("qid", *V, "node_id").agg(F.count("*").cast("double").alias("score"))


def two_stage_frames(questions: DataFrame, plans_: DataFrame, rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of each question: its reference window, then around the best visual rows (one a minute), then the
    plan's windows where frames are asked for; as many as its types want."""
    dense = F.arrays_overlap(F.transform("types", lambda t: F.lower(F.trim(t))), F.array(*map(F.lit, DENSE_TYPES)))
    q = questions.withColumn("budget", F.when(F.coalesce(dense, F.lit(False)), DENSE_FRAMES).otherwise(PLAIN_FRAMES))
    b = q.select("qid", "budget")
    flat = F.lit(False).alias("motion_rank")
    ref = q.where("ref_t0 is not null").select("qid", *V, F.least("ref_t0", "ref_t1").alias("t0"), tail_extended(F.least("ref_t0", "ref_t1"), F.greatest("ref_t0", "ref_t1")).alias("t1"), flat, "budget")
    first = live_frames(ref, frames, F.least("budget", F.greatest(F.lit(6), F.floor((F.col("t1") - F.col("t0")) / 12).cast("int")))).withColumns({"part": F.lit(0), "place": F.lit(0)})
    seen = rows.where(F.col("node_type").isin(*VISUAL_TYPES) & (F.col("block") == 1)).withColumn("mid", (F.col("t_start") + F.col("t_end")) / 2)
    moments = context.frames_to_show(seen.withColumn("score", -F.col("position").cast("double")), DENSE_FRAMES).select("qid", *V, "mid", "position")
    around = moments.select(F.concat_ws("/", "qid", "position").alias("rg_key"), F.col("qid").alias("rg_qid"), *V, F.greatest(F.lit(0.0), F.col("mid") - 5).alias("t0"), (F.col("mid") + 5).alias("t1"), "position")
    second = live_frames(around.select(F.col("rg_key").alias("qid"), *V, "t0", "t1", flat), frames, F.lit(2)).withColumnRenamed("qid", "rg_key").join(around.select("rg_key", "rg_qid", "position"), "rg_key")
    second = second.select(F.col("rg_qid").alias("qid"), *V, "ts", "frame_id", F.lit(1).alias("part"), F.col("position").alias("place"))
    asked = plans_.where("needs_frames").select("qid", *V, F.posexplode("windows").alias("pos", "w")).select(F.concat_ws("/", "qid", "pos").alias("rg_key"), F.col("qid").alias("rg_qid"), *V, F.col("w.t_start").alias("t0"), F.col("w.t_end").alias("t1"), "pos")
    third = live_frames(asked.select(F.col("rg_key").alias("qid"), *V, "t0", "t1", flat), frames, F.lit(4)).withColumnRenamed("qid", "rg_key").join(asked.select("rg_key", "rg_qid", "pos"), "rg_key")
    third = third.select(F.col("rg_qid").alias("qid"), *V, "ts", "frame_id", F.lit(2).alias("part"), F.col("pos").alias("place"))
    every = first.unionByName(second).unionByName(third)
    once = every.groupBy("qid", *V, "ts", "frame_id").agg(F.min(F.struct("part", "place")).alias("x")).join(b, "qid")
    return top_per_group(once, ["qid"], F.col("budget"), F.col("x.part"), F.col("x.place"), F.col("ts"), F.col("frame_id")).select("qid", *V, "ts", "frame_id")


def answer_two_stage(questions: DataFrame, nodes: DataFrame, frames: DataFrame, plan: Callable[[DataFrame], DataFrame], chat: Callable[[DataFrame], DataFrame], mcq: bool = True) -> DataFrame:
    """Plan, look up, and answer: qid, answer, batch_answers, subgraph_size, context.

    Frames are shown ten at a time, two of them again, and each batch sees what was said before; the answer
    is the one most batches gave.
    """
    shared_dir(questions.sparkSession)
    q = parsed_questions(questions).checkpoint()
    p = plans(plan(planner_prompts(q, nodes)), q).checkpoint()
    hits = plan_hits(p, q, nodes).checkpoint()
    planned = p.select("qid", *V, F.explode("windows").alias("w")).select("qid", *V, (F.col("w.t_start") - 5.0).alias("t0"), (F.col("w.t_end") + 5.0).alias("t1"))
    windows = planned.unionByName(context.search_windows(hits, nodes).select("qid", *V, "t0", "t1"))
    timed = q.withColumn("rg_end", tail_extended(F.least("ref_t0", "ref_t1"), F.greatest("ref_t0", "ref_t1"))).withColumns({"ref_t0": F.least("ref_t0", "ref_t1"), "ref_t1": F.col("rg_end")})
    rows = context.assemble(timed, nodes, hits, windows).checkpoint()
    text = context.context_text(rows)
    shown = two_stage_frames(q, p, rows, frames)
    batches = count_windows(shown, ["qid"], ["ts", "frame_id"], IMAGES, IMAGES - OVERLAP, "keep").groupBy("qid", F.col("window_idx").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("ts", "frame_id"))).alias("frames"))
    bare = q.select("qid").join(batches.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit(0).alias("batch"), F.array().cast("array<struct<ts:double,frame_id:string>>").alias("frames"))
    batches = batches.unionByName(bare).checkpoint()
    user = F.concat(F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "question")
    base = q.select("qid", "question").join(text, "qid", "left").select("qid", user.alias("user"))
    last = batches.agg(F.max("batch")).first()[0]
    said, before = None, None
    for k in range((last if last is not None else -1) + 1):  # as many rounds as the longest question has batches of ten frames
        prompt = batches.where(F.col("batch") == k).join(base, "qid").withColumn("system", F.lit(LETTER_ONLY if mcq else IN_WORDS))
        if before is not None:
            hint = before.select("qid", F.concat(F.lit("## Said of the frames before\n"), "text", F.lit("\n\nWhere these frames show otherwise, go by them.\n\n")).alias("hint"))
            prompt = prompt.join(hint, "qid", "left").withColumn("user", F.concat(F.coalesce("hint", F.lit("")), "user")).drop("hint")
        before = chat(prompt).select("qid", F.trim("text").alias("text"), F.lit(k).alias("batch")).checkpoint()
        said = before if said is None else said.unionByName(before)
    if said is None:
        return q.select("qid", F.lit("").alias("answer"), F.array().cast("array<string>").alias("batch_answers"), F.lit(0).cast("bigint").alias("subgraph_size"), F.lit("").alias("context"))
    each = said.withColumn("answer", answer_letter("text") if mcq else F.col("text"))
    kept = each.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("batch", "answer"))), lambda x: x["answer"]).alias("batch_answers"))
    sizes = rows.groupBy("qid").agg(F.count("*").alias("subgraph_size"))
    return context.voted(each).join(kept, "qid").join(sizes, "qid", "left").join(text, "qid", "left").select("qid", "answer", "batch_answers", F.coalesce("subgraph_size", F.lit(0).cast("bigint")).alias("subgraph_size"), "context")

