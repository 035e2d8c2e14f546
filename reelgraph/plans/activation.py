"""From a question to a budgeted subgraph: intents, seeds, expansion, pruning.

All questions of a batch run at once: tables are keyed by ``qid`` besides the graph's own keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_literal, question_type, words
from ..functions.vectors import cosine
from ..operators.graph import children, first_neighbour, nodes_in_window, reach, reach_all, spine_walk, undirected, with_parents
from ..operators.intervals import merged_spans, overlap_join
from ..operators.ranking import budget_prune, nearest_in_time, top_per_group
from ..operators.similarity import zero_shot
from ..schema import CAUSAL, INTENT_SIMILARITY, KEYWORD_INTENTS, LONG_SPAN, NO_CLIP, NODE_BUDGET, QUESTION_INTENTS, SEED_SIMILARITY
from ..shared import shared_dir

#: Relations that the spatial intent follows (fixed values).
SPATIAL_STEPS = ("LEFT_OF", "RIGHT_OF", "ABOVE", "BELOW", "IN_FRONT_OF", "BEHIND", "NEAR", "CONTAINS_SPATIAL")


def by_question_type(types: Column) -> Column:
    table = F.create_map(*[x for k, v in QUESTION_INTENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.coalesce(F.try_element_at(table, question_type(t)), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(found))


def by_keyword(question: Column) -> Column:
    """Substring rules; ``somewhere `` holds ``where ``, and so it counts."""
    text = F.concat(F.lower(question), F.lit(" "))
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(i)) for k, i in KEYWORD_INTENTS])))


def by_prototype(questions: DataFrame, intents: DataFrame) -> DataFrame:
    """Intents whose prototype is similar to the question's embedding, best first (qid, close)."""
    pairs = zero_shot(questions.select("qid", "embedding"), intents, "intent", INTENT_SIMILARITY, "qid")
    packed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "intent")))
    return pairs.groupBy("qid").agg(F.transform(packed, lambda x: x["intent"]).alias("close"))


def classify_intent(questions: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """Adds ``intents``: by question type, else by prototype, else by keyword, else SEMANTIC."""
    typed = by_question_type(list_literal("question_type"))
    q = questions
    tiers = [typed]
    if intents is not None:
        q = q.join(by_prototype(q, intents), "qid", "left")
        tiers.append(F.coalesce("close", F.array().cast("array<string>")))
    tiers.append(by_keyword(F.col("question")))
    out = F.array(F.lit("SEMANTIC"))
    for tier in reversed(tiers):
        out = F.when(F.size(tier) > 0, tier).otherwise(out)
    return q.withColumn("intents", out).drop("close")


def window_seeds(nodes: DataFrame, t0: float, t1: float, buffer: float = 30.0) -> DataFrame:
    """Ids of a window's nodes; if there are none, of the 20 that begin nearest to its middle."""
    seeds = nodes_in_window(nodes, t0, t1, buffer).select("node_id")
    none = seeds.limit(1).agg(F.count("*").alias("rg_n"))  # one row
    nearest = nearest_in_time(nodes, t0, t1).select("node_id").crossJoin(F.broadcast(none)).where("rg_n = 0").select("node_id")
    return seeds.unionByName(nearest).distinct()


def activate_window(
    nodes: DataFrame, edges: DataFrame, t0: float, t1: float, hops: int = 0, relations: Sequence[str] | None = None, most: int = NODE_BUDGET, intents: Sequence[str] = (), buffer: float = 30.0
) -> DataFrame:
    """Nodes of a window (or the 20 nearest to its middle), what the intents add, and parents, cut to a budget.

    CAUSAL follows causal edges three steps; IDENTITY and SEMANTIC add the nodes of the seeds' entities, their
    SAME_ENTITY neighbours and, if an episode overlaps the window, all characters; SPATIAL adds spatial
    neighbours, STATE the state changes inside the widened window.  ``hops`` adds what lies around the seeds.
    """
    seeds = window_seeds(nodes, t0, t1, buffer)
    parts = [reach(seeds, edges, hops, relations).select("node_id") if hops else seeds]
    if "CAUSAL" in intents:
        parts.append(reach(seeds, edges, 3, CAUSAL).select("node_id"))
    if "SPATIAL" in intents:
        parts.append(reach(seeds, edges, 1, SPATIAL_STEPS).select("node_id"))
    if "IDENTITY" in intents or "SEMANTIC" in intents:
        named = nodes.where("entity_id is not null").select("node_id", "entity_id")
        parts.append(named.join(named.join(seeds, "node_id").select("entity_id").distinct(), "entity_id", "left_semi").select("node_id"))
        parts.append(reach(seeds, edges, 1, ("SAME_ENTITY",)).select("node_id"))
        told = nodes.where((F.col("node_type") == "EpisodeNode") & (F.col("t_start") <= t1) & (F.col("t_end") >= t0)).limit(1).agg(F.count("*").alias("rg_n"))  # one row
        parts.append(nodes.where("node_type = 'CharacterNode'").select("node_id").crossJoin(F.broadcast(told)).where("rg_n > 0").select("node_id"))
    if "STATE" in intents:
        parts.append(nodes.where((F.col("node_type") == "StateChangeNode") & (F.col("t_start") >= t0 - buffer) & (F.col("t_end") <= t1 + buffer)).select("node_id"))
    active = parts[0]
    for part in parts[1:]:
        active = active.unionByName(part)
    if "parent_id" in nodes.columns:
        active = with_parents(active.distinct(), nodes)
    marked = active.distinct().join(seeds.withColumn("is_seed", F.lit(True)), "node_id", "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    return budget_prune(nodes.join(marked, "node_id"), [], F.col("is_seed"), most)


def activate_references(questions: DataFrame, nodes: DataFrame, edges: DataFrame, on: Sequence[str] = ("video_id",), most: int = NODE_BUDGET, buffer: float = 30.0) -> DataFrame:
    """As ``activate_window`` for all questions (qid, intents, ref_t0, ref_t1) at once: node rows with qid and is_seed."""
    shared_dir(questions.sparkSession)
    k = ["qid", *on]
    ends = (F.least("ref_t0", "ref_t1"), F.greatest("ref_t0", "ref_t1"))
    q = questions.where("ref_t0 is not null and ref_t1 is not null").select(*k, ends[0].alias("a_t0"), ends[1].alias("a_t1"), F.coalesce("intents", F.array().cast("array<string>")).alias("intents"))
    spans = nodes.select(*on, "node_id", "node_type", F.col("t_start").alias("b_t0"), F.col("t_end").alias("b_t1"))
    inside = overlap_join(q, spans, on, width=60.0, buffer=buffer).select(*k, "node_id")
    bare = q.join(inside.select("qid").distinct(), "qid", "left_anti")
    near = top_per_group(bare.join(spans, list(on)), ["qid"], 20, F.abs(F.col("b_t0") - (F.col("a_t0") + F.col("a_t1")) / 2), F.col("node_id"))
    seeds = inside.unionByName(near.select(*k, "node_id")).distinct().checkpoint()
    at = lambda *names: seeds.join(q.where(F.arrays_overlap("intents", F.array(*map(F.lit, names)))).select("qid"), "qid", "left_semi")
    who = at("IDENTITY", "SEMANTIC")
    named = nodes.where("entity_id is not null").select(*on, "node_id", "entity_id")
    ids = who.join(named, [*on, "node_id"]).select(*k, "entity_id").distinct()
    told = overlap_join(q.where(F.arrays_overlap("intents", F.array(F.lit("IDENTITY"), F.lit("SEMANTIC")))), spans.where("node_type = 'EpisodeNode'"), on, width=600.0).select(*k).distinct()
    states = q.where(F.array_contains("intents", "STATE")).join(spans.where("node_type = 'StateChangeNode'"), list(on)).where((F.col("b_t0") >= F.col("a_t0") - buffer) & (F.col("b_t1") <= F.col("a_t1") + buffer))
    parts = [
        reach(at("CAUSAL"), edges, 3, CAUSAL, k), reach(at("SPATIAL"), edges, 1, SPATIAL_STEPS, k), reach(who, edges, 1, ("SAME_ENTITY",), k),
        ids.join(named, [*on, "entity_id"]), told.join(nodes.where("node_type = 'CharacterNode'").select(*on, "node_id"), list(on)), states,
    ]
    active = seeds
    for part in parts:
        active = active.unionByName(part.select(*k, "node_id"))
    active = with_parents(active.distinct(), nodes, k)
    marked = active.join(seeds.withColumn("is_seed", F.lit(True)), [*k, "node_id"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    return budget_prune(marked.join(nodes, [*on, "node_id"]), ["qid"], F.col("is_seed"), most)


def least_precision(active: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """The least temporal precision among active nodes, 999 where there is none; above a threshold the graph has a hole there."""
    least = F.coalesce(F.min("temporal_precision"), F.lit(NO_CLIP)).alias("least_precision")
    return active.groupBy(*on).agg(least) if on else active.agg(least)


def seeds_by_similarity(questions: DataFrame, vectors: DataFrame, k: int = 20, least: float = SEED_SIMILARITY, on: Sequence[str] = ("video_id",)) -> DataFrame:
    """The k best nodes of each question's video at or above a similarity; the cut by k comes first."""
    pairs = questions.select("qid", *on, F.col("embedding").alias("rg_q")).join(vectors.select(*on, "node_id", "embedding"), list(on))
    scored = pairs.withColumn("score", F.round(cosine("rg_q", "embedding"), 6))
    return top_per_group(scored, ["qid"], k, F.desc("score"), F.col("node_id")).where(F.col("score") >= least).select("qid", *on, "node_id", "score")


#: Relations that an intent follows from the seeds, and how far; emotional shifts are followed to their end.
WALKS = {"CAUSAL": (CAUSAL, 3), "COUNTERFACT": (CAUSAL, 2), "INTENTIONAL": (("MOTIVATES",), 3), "SPATIAL": (SPATIAL_STEPS, 1), "IDENTITY": (("SAME_ENTITY",), 1)}


def _around(times: DataFrame, nodes: DataFrame, k: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Nodes that overlap any of the times (s0, s1) of a question, found over the times' union."""
    spans = merged_spans(times.select(*k, F.col("s0").alias("b_t0"), F.col("s1").alias("b_t1")), k)
    return overlap_join(nodes.select(*on, "node_id", F.col("t_start").alias("a_t0"), F.col("t_end").alias("a_t1")), spans, on).select(*k, "node_id")


def activate(questions: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, on: Sequence[str] = ("video_id",), most: int = NODE_BUDGET, follow_arc: bool = False) -> DataFrame:
    """Active nodes of each question: seeds, what its intents reach, parents, cut to the budget.

    ``questions``: qid, question, intents; ``seeds``: qid and node_id.  Returns the node rows with qid and
    is_seed.
    """
    k = ["qid", *on]
    shared_dir(questions.sparkSession)
    seeds = seeds.select(*k, "node_id").distinct().checkpoint()  # a dozen walks begin here
    at = lambda intent: seeds.join(questions.where(F.array_contains("intents", intent)).select("qid"), "qid", "left_semi")
    out = seeds

    for intent, (relations, depth) in WALKS.items():
        out = out.unionByName(reach(at(intent), edges, depth, relations, k).select(*k, "node_id"))

    temporal = at("TEMPORAL")
    spans = temporal.join(nodes.select(*on, "node_id", "t_start", "t_end"), [*on, "node_id"]).groupBy(*k).agg(F.min("t_start").alias("lo"), F.max("t_end").alias("hi"))
    wide = spans.where(F.col("hi") - F.col("lo") > LONG_SPAN)
    episodes = nodes.where("node_type = 'EpisodeNode'")
    inside = wide.join(episodes.select(*on, "node_id", "t_start", "t_end"), list(on)).where("t_start <= hi and t_end >= lo").select(*k, "node_id")
    out = out.unionByName(inside)
    if follow_arc:
        out = out.unionByName(spine_walk(inside, edges, 3, "NARRATIVE_ARC", k).select(*k, "node_id"))
    narrow = temporal.join(wide.select(*k), k, "left_anti")
    out = out.unionByName(spine_walk(narrow, edges, 4, "PRECEDES", k).select(*k, "node_id"))

    named = nodes.where("entity_id is not null").select(*on, "node_id", "entity_id")
    ids = at("IDENTITY").join(named, [*on, "node_id"]).select(*k, "entity_id").distinct()
    out = out.unionByName(ids.join(named, [*on, "entity_id"]).select(*k, "node_id"))
    nameless = at("IDENTITY").join(nodes.where("entity_id is null").select(*on, "node_id"), [*on, "node_id"]).select(*k).distinct()
    out = out.unionByName(nameless.join(nodes.where("entity_id is null and node_type = 'CharacterNode'").select(*on, "node_id"), list(on)).select(*k, "node_id"))

    asked = questions.where(F.array_contains("intents", "STATE")).select(*k, words("question").alias("rg_w"))
    state = asked.join(nodes.where("node_type = 'StateChangeNode'").select(*on, "node_id", F.lower(F.concat_ws(" ", "label", F.try_element_at("meta_extra", F.lit("entity")))).alias("rg_t")), list(on))
    out = out.unionByName(state.where(F.exists("rg_w", lambda w: F.contains("rg_t", w))).select(*k, "node_id"))

    whole = questions.where(F.array_contains("intents", "SUMMARY")).select(*k).join(episodes.select(*on, "node_id"), list(on)).select(*k, "node_id")
    out = out.unionByName(whole).unionByName(children(whole, edges, 1, k).select(*k, "node_id"))

    places = first_neighbour(edges, "TAKES_PLACE_IN", on).select(*on, F.col("node").alias("node_id"), "neighbour")
    out = out.unionByName(at("COUNTERFACT").join(places, [*on, "node_id"]).select(*k, F.col("neighbour").alias("node_id")))

    spans = nodes.select(*on, "node_id", "node_type", F.col("t_start").alias("s0"), F.col("t_end").alias("s1"))
    characters = nodes.where("node_type = 'CharacterNode'").select(*on, "node_id", "t_start", "t_end")
    felt = at("EMOTIONAL").join(spans, [*on, "node_id"])
    people = _around(felt, characters, k, on).distinct()
    starts = people.unionByName(felt.where("node_type = 'CharacterNode'").select(*k, "node_id")).distinct()
    moved = reach_all(starts, edges, ("EMOTION_SHIFT",), k).select(*k, "node_id")
    times = moved.join(spans.where("node_type = 'CharacterNode'"), [*on, "node_id"]).select(*k, "s0", "s1").distinct()
    scenes = _around(times, nodes.where("node_type = 'SceneNode'").select(*on, "node_id", "t_start", "t_end"), k, on)
    out = out.unionByName(moved).unionByName(scenes)
    acting = at("INTENTIONAL").join(spans.where("node_type in ('ActionNode', 'SceneNode', 'ClipNode')"), [*on, "node_id"]).select(*k, "s0", "s1")
    out = out.unionByName(_around(acting, characters, k, on))

    late = at("PROSPECTIVE").join(nodes.select(*on, "node_id", "t_start"), [*on, "node_id"])
    latest = top_per_group(late, k, 5, F.desc("t_start"), F.col("node_id"))
    out = out.unionByName(spine_walk(latest, edges, 3, "PRECEDES", k, ("forward",)).select(*k, "node_id"))
    edge = top_per_group(late.join(spans.select(*on, "node_id", "s1"), [*on, "node_id"]), k, 1, F.desc("t_start"), F.col("node_id")).select(*k, "s1")
    out = out.unionByName(top_per_group(edge.join(episodes.select(*on, "node_id", "t_start"), list(on)).where("t_start >= s1"), k, 1, F.col("t_start"), F.col("node_id")).select(*k, "node_id"))

    active = with_parents(out.distinct(), nodes, k)
    marked = active.join(seeds.withColumn("is_seed", F.lit(True)), [*k, "node_id"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    return budget_prune(marked.join(nodes, [*on, "node_id"]), ["qid"], F.col("is_seed"), most)


def surroundings(edges: DataFrame, on: Sequence[str] = ("video_id",)) -> DataFrame:
    return undirected(edges, None, on)
