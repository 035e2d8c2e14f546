"""Hop-synchronous walks over the graph for a batch of questions.

State lives in tables keyed by ``qid``: the nodes of each walk with the hop that added them, and its
frontier.  Each hop is a fixed set of joins over all questions that still walk; model calls (choosing an
action, answering) are functions from a table to a table.  A walk ends when its warrant is satisfied.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators.graph import expand
from ..operators.intervals import overlap_join
from ..operators.ranking import top_per_group
from ..schema import BUILD_DEFAULT, BUILD_MOST_FRAMES, BUILD_WINDOWS, FAMILIES, FRONTIER_K, HOPS, SCENE_JSON, SEARCH_SIMILARITY, WINDOW_BUFFER, ZOOM_BUFFER
from ..shared import shared_dir
from .warrant import coverage, elasticity, facts, required_slots, satisfied

V = ["video_id"]
FRAMES_KEPT, FRAME_BUCKET = 10, 10.0


@dataclass
class Walk:
    """questions: qid, video_id, question, types, options, has_frames, discriminated, slots.
    nodes: qid, video_id, node_id, hop.  answers: qid, letter, hop, coverage, satisfied."""

    questions: DataFrame
    nodes: DataFrame
    answers: DataFrame | None = None


def held(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def seeded(questions: DataFrame, active: DataFrame, nodes: DataFrame) -> Walk:
    """Walks from activated nodes; a question without any starts from six episodes, else from ten nodes."""
    q = questions.withColumn("slots", required_slots(F.col("types"), F.size(F.coalesce("options", F.expr("map()").cast("map<string,string>"))) > 0))
    first = active.select("qid", *V, "node_id").distinct()
    bare = q.select("qid", *V).join(first.select("qid").distinct(), "qid", "left_anti")
    episodes = top_per_group(bare.join(nodes.where("node_type = 'EpisodeNode'").select(*V, "node_id", "t_start"), V), ["qid"], 6, F.col("t_start"), F.col("node_id")).select("qid", *V, "node_id")
    rest = bare.join(episodes.select("qid").distinct(), "qid", "left_anti")
    any_ = top_per_group(rest.join(nodes.select(*V, "node_id", "ord"), V), ["qid"], 10, F.col("ord"), F.col("node_id")).select("qid", *V, "node_id")
    return Walk(q, held(first.unionByName(episodes).unionByName(any_).withColumn("hop", F.lit(0))))


def zoomed(actions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes around each action's node, five seconds to both sides."""
    a = actions.where("action = 'ZOOM'").join(nodes.select(*V, "node_id", F.col("t_start").alias("z0"), F.col("t_end").alias("z1")), [*V, "node_id"]).select("qid", *V, "z0", "z1")
    return a.join(nodes.select(*V, "node_id", "t_start", "t_end"), V).where((F.col("t_start") <= F.col("z1") + ZOOM_BUFFER) & (F.col("t_end") >= F.col("z0") - ZOOM_BUFFER)).select("qid", *V, "node_id")


def recalled(queries: DataFrame, vectors: DataFrame, k: int = 2 * FRONTIER_K, least: float = SEARCH_SIMILARITY) -> DataFrame:
    """The best nodes for each query (qid, embedding) of its video."""
    j = queries.select("qid", *V, F.col("embedding").alias("rg_q")).join(vectors.select(*V, "node_id", "embedding"), V).withColumn("score", F.round(cosine("rg_q", "embedding"), 6))
    return top_per_group(j, ["qid"], k, F.desc("score"), F.col("node_id")).where(F.col("score") >= least).select("qid", *V, "node_id")


def discriminated(actions: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes found for an option with the question, and the first five appearances of their entities."""
    found = recalled(actions.where("action = 'DISCRIMINATE' and embedding is not null"), vectors)
    named = nodes.where("entity_id is not null").select(*V, "node_id", "entity_id", "t_start")
    ids = found.join(named, [*V, "node_id"]).select("qid", *V, "entity_id").distinct()
    traced = top_per_group(ids.join(named, [*V, "entity_id"]), ["qid", "entity_id"], 5, F.col("t_start"), F.col("node_id"))
    return found.unionByName(traced.select("qid", *V, "node_id")).distinct()


def forced_action(gap: Column, missing: Column) -> tuple[Column, Column]:
    """Action and family or option where the model's own choice does not serve the first gap."""
    action = F.when(gap == "mcq_option_coverage", "DISCRIMINATE").when(gap.isin("causal_edge", "entity_or_frame"), "BUILD").when(gap.isin("temporal_occurrences", "episode_summary"), "EXPAND").otherwise("RECALL")
    detail = F.when(gap == "mcq_option_coverage", F.try_element_at(missing, F.lit(1))).when(gap == "temporal_occurrences", "entity").when(gap == "episode_summary", "contains")
    return action, detail


def build_window(gap: Column, times: Column) -> Column:
    """Struct (radius, frames) of what is looked at anew; it doubles with every time before."""
    table = F.create_map(*[x for k, (r, f) in BUILD_WINDOWS.items() for x in (F.lit(k), F.struct(F.lit(r).alias("radius"), F.lit(f).alias("frames")))])
    base = F.coalesce(F.try_element_at(table, gap), F.struct(F.lit(BUILD_DEFAULT[0]).alias("radius"), F.lit(BUILD_DEFAULT[1]).alias("frames")))
    more = F.pow(F.lit(2.0), times)
    return F.struct((base["radius"] * more).alias("radius"), F.least(F.lit(BUILD_MOST_FRAMES), (base["frames"] * more).cast("int")).alias("frames"))


def anchors(questions: DataFrame, hits: DataFrame, frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where to look anew: mean start of the three best hits, else the middle of the reference, else of the frontier, else the mean of all, else 0."""
    times = nodes.select(*V, "node_id", "t_start", "t_end")
    best = top_per_group(hits, ["qid"], 3, F.desc("score"), F.col("node_id")).join(times, [*V, "node_id"]).groupBy("qid").agg(F.avg("t_start").alias("a"))
    ring = frontier.join(times, [*V, "node_id"]).groupBy("qid").agg(((F.min("t_start") + F.max("t_end")) / 2).alias("b"))
    every = nodes.groupBy(*V).agg(F.avg("t_start").alias("c"))
    j = questions.join(best, "qid", "left").join(ring, "qid", "left").join(every, V, "left")
    return j.select("qid", *V, F.coalesce("a", (F.col("ref_t0") + F.col("ref_t1")) / 2, "b", "c", F.lit(0.0)).alias("anchor"))


def kept_frames(frames: DataFrame) -> DataFrame:
    """The first frame of each ten seconds, the last ten of each question; older ones are for text only (archived)."""
    w = Window.partitionBy("qid", F.floor(F.col("ts") / FRAME_BUCKET)).orderBy("added", "ts")
    first = frames.withColumn("rg_n", F.row_number().over(w)).where("rg_n = 1").drop("rg_n")
    late = Window.partitionBy("qid").orderBy(F.desc("added"), F.desc("ts"))
    return first.withColumn("archived", F.row_number().over(late) > FRAMES_KEPT)


def absorbed(walk: Walk, found: DataFrame, hop: int) -> Walk:
    """The walk with what it did not know, as the ring of this hop."""
    ring = found.select("qid", *V, "node_id").distinct().join(walk.nodes.select("qid", "node_id"), ["qid", "node_id"], "left_anti").withColumn("hop", F.lit(hop))
    return Walk(walk.questions, held(walk.nodes.unionByName(ring)), walk.answers)


def warranted(walk: Walk, nodes: DataFrame, edges: DataFrame, full: DataFrame, ablated: DataFrame, theta: float = 1.0) -> DataFrame:
    """Coverage, gaps, elasticity and verdict of each walk; answers are tables (qid, letter)."""
    chosen = walk.nodes.select("qid", *V, "node_id").join(nodes, [*V, "node_id"])
    c = coverage(facts(walk.questions, chosen, edges.drop("video_id")))
    j = c.join(full.select("qid", F.col("letter").alias("letter")), "qid", "left").join(ablated.select("qid", F.col("letter").alias("rg_a")), "qid", "left")
    j = j.withColumn("elasticity", elasticity(F.col("letter"), F.col("rg_a")))
    return j.withColumn("satisfied", satisfied(theta)).drop("rg_a")


def frame_texts(frames: DataFrame, nodes: DataFrame, around: float = 3.0, buffer: float = WINDOW_BUFFER) -> DataFrame:
    """What stands in for an archived frame (qid, video_id, ts): labels and descriptions around it, each once, 600 characters."""
    wanted = frames.select("qid", *V, "ts").distinct()
    said = F.array_compact(F.array(F.when(F.length("label") > 3, F.col("label")), F.left(F.expr("nullif(canonical_description, '')"), F.lit(200))))
    each = nodes.where("t_start is not null and t_end is not null").select(*V, "t_start", "t_end", "ord", F.posexplode(said).alias("pos", "text"))
    # what ends no later than an earlier node of the same text is never the first of it around a frame
    earlier = Window.partitionBy(*V, "text").orderBy("t_start", "ord", "pos").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("rg_end", F.max("t_end").over(earlier)).where("rg_end is null or t_end > rg_end").drop("rg_end")
    spans = each.withColumns({"b_t0": F.least("t_start", "t_end"), "b_t1": F.greatest("t_start", "t_end")})
    times = wanted.select(*V, "ts").distinct().withColumns({"a_t0": F.col("ts") - around - buffer, "a_t1": F.col("ts") + around + buffer})
    j = overlap_join(times, spans, V).where("t_start <= a_t1 and t_end >= a_t0")
    first = j.groupBy(*V, "ts", "text").agg(F.min(F.struct("t_start", "ord", "pos")).alias("at"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    texts = first.groupBy(*V, "ts").agg(F.left(F.array_join(packed, " | "), F.lit(600)).alias("text"))
    return wanted.join(texts, [*V, "ts"], "left").select("qid", *V, "ts", "text").withColumn("text", F.coalesce("text", F.lit("(no caption)")))


def minted(perceived: DataFrame, hop: int) -> DataFrame:
    """New nodes out of scene records (qid, video_id, t0, t1, raw_json) of windows that were looked at anew."""
    r = perceived.withColumn("s", F.from_json("raw_json", SCENE_JSON)).withColumn("mid", (F.col("t0") + F.col("t1")) / 2)
    when = lambda x: F.when(x["approx_timestamp"] != 0, x["approx_timestamp"])

    def of(kind: str, column: str, label, at=None, **meta):
        rows = r.select("qid", *V, "mid", F.posexplode(f"s.{column}").alias("pos", "x"))
        x = F.col("x")
        t = F.coalesce(at(x), F.col("mid")) if at else F.col("mid")
        more = F.create_map(*[F.lit(v) for v in ("source", "build_perceive", "build_hop", str(hop))], *[c for k, v in meta.items() for c in (F.lit(k), F.coalesce(x[v], F.lit("")))])
        return rows.select("qid", *V, F.concat_ws("_", F.lit(f"build_h{hop}"), "qid", F.lit(kind), "pos").alias("node_id"), F.lit(kind).alias("node_type"), F.left(F.trim(label(x)), F.lit(200)).alias("label"), t.alias("t_start"), t.alias("t_end"), more.alias("meta_extra")).where("label <> ''")

    parts = [
        of("OCRNode", "ocr_text", lambda x: x["text"]), of("CharacterNode", "characters", lambda x: x["description"], emotion="emotion"), of("ActionNode", "actions", lambda x: x["description"], when, actor="actor"),
        of("StateChangeNode", "state_changes", lambda x: F.concat(F.coalesce(x["entity"], F.lit("")), F.lit(": "), F.coalesce(x["from_state"], F.lit("")), F.lit("→"), F.coalesce(x["to_state"], F.lit(""))), when),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Builder:
    """What BUILD looks with: the frame table, and functions from prompts to what a model sees.

    ``perceive(prompts)`` gives qid and raw_json, the scene record of a window; ``infer(prompts)`` gives
    video_id, qid, pos, cause, effect, relation_type, confidence among the walk's nodes.
    """

    frames: DataFrame
    perceive: Callable[[DataFrame], DataFrame]
    infer: Callable[[DataFrame], DataFrame]


def built(builder: Builder, asked: DataFrame, walk: Walk, nodes: DataFrame, edges: DataFrame, times: DataFrame, hop: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New nodes, new edges and the frames seen, for walks (qid, video_id, gap) that build; ``times``: qid, times."""
    from .answering import live_frames
    from .build import online_causal_edges

    q = walk.questions.join(asked.select("qid", "gap"), "qid")
    for c in ("ref_t0", "ref_t1"):
        if c not in q.columns:
            q = q.withColumn(c, F.lit(None).cast("double"))
    frontier = walk.nodes.join(walk.nodes.groupBy("qid").agg(F.max("hop").alias("hop")), ["qid", "hop"])
    hits = walk.nodes.select("qid", *V, "node_id").where("false").withColumn("score", F.lit(0.0))
    at = anchors(q, hits, frontier, nodes).join(q.select("qid", "gap"), "qid").join(times, "qid", "left")
    w = build_window(F.col("gap"), F.coalesce("times", F.lit(0)))
    windows = held(at.select("qid", *V, "gap", F.greatest(F.lit(0.0), F.col("anchor") - w["radius"]).alias("t0"), (F.col("anchor") + w["radius"]).alias("t1"), w["frames"].alias("rg_frames")))
    seen = held(live_frames(windows.withColumn("motion_rank", F.lit(True)), builder.frames, F.col("rg_frames")))
    shown = windows.drop("rg_frames").join(seen.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ts", "frame_id"))).alias("frames")), "qid", "left")
    looks = F.col("gap").isin("entity_or_frame", "mcq_option_coverage")
    records = builder.perceive(shown.where(looks & F.col("frames").isNotNull()))
    fresh = held(minted(shown.select("qid", *V, "t0", "t1").join(records.select("qid", "raw_json"), "qid"), hop))
    events = walk.nodes.select("qid", *V, "node_id").join(nodes, [*V, "node_id"])
    inside = events.join(shown.where(~looks).select("qid", "t0", "t1"), "qid").where("t_start <= t1 and t_end >= t0")
    links = builder.infer(shown.where(~looks))
    return fresh, held(online_causal_edges(links, inside, edges)), seen


def run(walk: Walk, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, choose: Callable[[DataFrame, DataFrame], DataFrame], answer: Callable[[DataFrame, DataFrame], DataFrame], hops: int = HOPS, theta: float = 1.0, builder: Builder | None = None, log: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Walk all questions; returns qid, letter, hop, coverage and whether it was warranted.

    BUILD looks at the video anew with a ``builder``: what it sees becomes nodes, what it infers edges; without
    one it recalls.  ``log`` gets each hop's record: verdict, gaps, action and the number of nodes.

    ``choose(questions, nodes)`` gives qid, video_id, action, relation, node_id, option, embedding.
    ``answer(questions, nodes)`` gives qid, letter.  A walk whose action is ANSWER or STOP is turned to the
    action that its first gap asks for, as an unsatisfied walk may not end.
    """
    done = None
    live, times = walk, walk.questions.select("qid", F.lit(0).alias("times"))
    for hop in range(hops + 1):
        full = held(answer(live.questions, live.nodes))
        last = live.nodes.groupBy("qid").agg(F.max("hop").alias("rg_h"))
        inner = live.nodes.join(last, "qid").where((F.col("rg_h") == 0) | (F.col("hop") < F.col("rg_h"))).drop("rg_h")
        verdict = held(warranted(live, nodes, edges, full, answer(live.questions, inner), theta).withColumn("hop", F.lit(hop)))
        over = verdict if hop == hops else verdict.where("satisfied")
        out = over.select("qid", "letter", "hop", "coverage", "satisfied")
        done = out if done is None else done.unionByName(out)
        open_ = verdict.where("not satisfied")
        if hop == hops or not open_.take(1):
            break
        ids = open_.select("qid")
        live = Walk(live.questions.join(ids, "qid", "left_semi"), live.nodes.join(ids, "qid", "left_semi"))
        gap = F.try_element_at("gaps", F.lit(1))
        forced, detail = forced_action(gap, F.col("missing_options"))
        a = choose(live.questions, live.nodes).join(open_.select("qid", "gaps", "missing_options"), "qid")
        ends = F.col("action").isin("ANSWER", "STOP")
        a = held(a.withColumns({"relation": F.when(ends, detail).otherwise(F.col("relation")), "option": F.when(ends, detail).otherwise(F.col("option")), "action": F.when(ends, forced).otherwise(F.col("action"))}))
        if log is not None:
            log(verdict.join(a.select("qid", "action", "relation", "option"), "qid", "left").join(live.nodes.groupBy("qid").agg(F.count("*").alias("n_nodes")), "qid", "left"))
        frontier = live.nodes.join(live.nodes.groupBy("qid").agg(F.max("hop").alias("hop")), ["qid", "hop"])
        recalls = ("RECALL",) if builder else ("RECALL", "BUILD")
        parts = [zoomed(a, nodes), recalled(a.where(F.col("action").isin(*recalls) & F.col("embedding").isNotNull()), vectors), discriminated(a, nodes, vectors)]
        if builder:
            asked = held(a.where("action = 'BUILD'").select("qid", F.coalesce(F.try_element_at("gaps", F.lit(1)), F.lit("any_evidence")).alias("gap")))
            fresh, links, seen = built(builder, asked, live, nodes, edges, times, hop + 1)
            nodes = held(nodes.unionByName(fresh.drop("qid"), allowMissingColumns=True))
            edges = held(edges.unionByName(links, allowMissingColumns=True))
            times = held(times.join(asked.select("qid", F.lit(1).alias("rg_1")), "qid", "left").select("qid", (F.col("times") + F.coalesce("rg_1", F.lit(0))).alias("times")))
            looked = seen.select("qid").distinct().withColumn("rg_seen", F.lit(True))
            live = Walk(held(live.questions.join(looked, "qid", "left").withColumn("has_frames", F.coalesce("has_frames", F.lit(False)) | F.coalesce("rg_seen", F.lit(False))).drop("rg_seen")), live.nodes)
            parts.append(fresh.select("qid", *V, "node_id"))
        mine = live.questions.select("qid", *V)
        for family in FAMILIES:
            of = frontier.join(a.where((F.col("action") == "EXPAND") & (F.col("relation") == family)).select("qid"), "qid", "left_semi")
            near = expand(of, mine.join(nodes, V), mine.join(edges, V), family, FRONTIER_K, ["qid", *V])
            parts.append(near.select("qid", *V, F.col("neighbour").alias("node_id")))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        live = absorbed(live, found, hop + 1)
    return done
