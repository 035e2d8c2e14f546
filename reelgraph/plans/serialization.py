"""Evidence as text: ordered lines in sections, one context per question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import deduplicated, hydrated
from ..operators.ranking import top_per_group
from ..schema import CAUSAL, FOCUS, SPATIAL

# Node types that matter by question type; scenes and episodes always do.
RELEVANT = {
    "key information retrieval": ("OCRNode", "SpeechNode", "ClipNode", "CharacterNode"),
    "entity recognition": ("CharacterNode", "ObjectNode", "ClipNode", "SceneNode"),
    "event understanding": ("CharacterNode", "ActionNode", "InteractionNode", "StateChangeNode", "ClipNode", "SceneNode"),
    "reasoning": ("CharacterNode", "ActionNode", "CauseNode", "GoalNode", "SpeechNode", "StateChangeNode", "EpisodeNode"),
    "temporal grounding": ("CharacterNode", "ClipNode", "SceneNode", "ActionNode", "StateChangeNode"),
    "summarization": ("CharacterNode", "EpisodeNode", "SceneNode", "ActionNode", "SpeechNode"),
    "emotional reasoning": ("CharacterNode", "SceneNode", "SpeechNode"),
    "intentional reasoning": ("CharacterNode", "ActionNode", "SpeechNode", "EpisodeNode"),
    "prospective reasoning": ("SceneNode", "EpisodeNode", "ActionNode"),
    "counterfactual reasoning": ("CharacterNode", "ActionNode", "StateChangeNode", "SceneNode", "EpisodeNode"),
    "spatial understanding": ("SceneNode", "ObjectNode", "CharacterNode", "LocationNode"),
}
ALWAYS = ("SceneNode", "EpisodeNode")
EDGE_SECTION = (*CAUSAL, "SAME_ENTITY", "SPOKEN_BY", "EMOTION_SHIFT")


def _sec(t: str | Column) -> Column:
    return F.format_string("%.0fs", F.col(t) if isinstance(t, str) else t)


def timeline(nodes: DataFrame, on: Sequence[str], *order: str) -> DataFrame:
    """A plain line per node, in order, as one text per group."""
    line = F.format_string("[%d-%d] %s: %s", F.floor("t_start"), F.floor("t_end"), F.col("node_type"), F.col("label"))
    packed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return nodes.groupBy(*on).agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("context"))


def relevant(types: Column, node_type: Column) -> Column:
    """Does a node type matter for the question's types?  Unknown types let all pass."""
    table = F.create_map(*[x for k, v in RELEVANT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    cleaned = F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.regexp_replace(F.trim(t), r"^['\[\]]+|['\[\]]+$", ""))
    allowed = F.flatten(F.transform(cleaned, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return (F.size(allowed) == 0) | F.array_contains(allowed, node_type) | node_type.isin(*ALWAYS)


def _timeline_lines(questions: DataFrame, chosen: DataFrame, on: Sequence[str]) -> DataFrame:
    n = chosen.join(questions.select(*on, "types", "ref_t0", "ref_t1", "visual_provided"), list(on)).where(relevant(F.col("types"), F.col("node_type")))
    n = n.where(~(F.coalesce("visual_provided", F.lit(False)) & F.col("node_type").isin("ActionNode", "ObjectNode")))
    inside = F.coalesce(F.col("t_start").between(F.col("ref_t0") - FOCUS, F.col("ref_t1") + FOCUS), F.lit(False))
    by = Window.partitionBy(*on)  # the nodes of one question, at most its budget
    n = n.withColumn("rg_in", inside).withColumn("rg_any", F.bool_or("rg_in").over(by)).where("rg_in or not rg_any")
    scenes = F.sum((F.col("node_type") == "SceneNode").cast("int")).over(by)
    n = n.withColumn("grouped", F.coalesce((F.col("ref_t1") - F.col("ref_t0") > 60) & (scenes >= 2), F.lit(False)))
    title = n.select(*on, "grouped").distinct().select(*on, F.lit(1).alias("section"), F.lit(-1.0).alias("o1"), F.lit("").alias("o2"), F.when(F.col("grouped"), "## Timeline (grouped by segment)").otherwise("## Timeline").alias("line"))
    sure = F.when(F.col("confidence") < 0.8, F.format_string(" (confidence: %.2f)", "confidence")).otherwise("")
    gap = F.when(F.col("temporal_precision") > 8, F.concat(F.lit(" [gap:"), _sec("temporal_precision"), F.lit("]"))).otherwise("")
    role = F.coalesce(F.concat(F.lit(" ["), F.expr("nullif(try_element_at(meta_extra, 'narrative_function'), '')"), F.lit("]")), F.lit(""))
    flat = n.where(~F.col("grouped")).select(*on, F.lit(1).alias("section"), F.col("t_start").alias("o1"), F.col("node_id").alias("o2"), F.concat(F.lit("  ["), _sec("t_start"), F.lit("–"), _sec("t_end"), F.lit("] ["), "node_type", F.lit("]"), role, F.lit(" "), "label", sure, gap).alias("line"))
    sc = n.where(F.col("grouped") & (F.col("node_type") == "SceneNode")).select(*on, F.col("t_start").alias("s0"), F.col("t_end").alias("s1"), F.col("node_id").alias("scene"), F.col("label").alias("scene_label"))
    heads = sc.select(*on, F.lit(1).alias("section"), F.col("s0").alias("o1"), F.concat("scene", F.lit("\0")).alias("o2"), F.concat(F.lit("  --- ["), _sec("s0"), F.lit("–"), _sec("s1"), F.lit("] "), "scene_label", F.lit(" ---")).alias("line"))
    low = F.when(F.col("confidence") < 0.8, F.format_string(" (conf:%.2f)", "confidence")).otherwise("")
    inner = n.where(F.col("grouped") & (F.col("node_type") != "SceneNode")).join(sc, list(on)).where(F.col("t_start").between(F.col("s0"), F.col("s1")))
    inner = inner.select(*on, F.lit(1).alias("section"), F.col("s0").alias("o1"), F.concat("scene", F.lit("\1"), F.format_string("%020.3f", "t_start"), "node_id").alias("o2"), F.concat(F.lit("    ["), "node_type", F.lit("] "), "label", low).alias("line"))
    return title.unionByName(flat).unionByName(heads).unionByName(inner)


def serialize(questions: DataFrame, chosen: DataFrame, edges: DataFrame, on: Sequence[str] = ("qid",), include_edges: bool = False) -> DataFrame:
    """The context of each question.

    ``questions``: question, intents, types, ref_t0, ref_t1, visual_provided.  ``chosen``: the question's
    nodes.  ``edges``: the question's induced edges, with weight and confidence.  Sections in this order:
    focus window, timeline, causal relationships, characters, emotional arc, state changes, spatial
    layout, episode summaries, dialogue, what happens next, graph edges.
    """
    q = questions
    intent = lambda name: F.array_contains(F.coalesce("intents", F.array().cast("array<string>")), name)
    typed = lambda word: F.exists(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.contains(t, F.lit(word)))
    empty_string = F.lit("")

    def lines(df: DataFrame, section: int, o1: Column, o2: Column, line: Column) -> DataFrame:
        return df.select(*on, F.lit(section).alias("section"), o1.cast("double").alias("o1"), o2.cast("string").alias("o2"), line.alias("line"))

    def titled(df: DataFrame, section: int, title: str) -> DataFrame:
        return df.unionByName(lines(df.select(*on).distinct(), section, F.lit(-1e18), empty_string, F.lit("\n## " + title)))

    focus = q.where("ref_t0 is not null and ref_t1 is not null")
    parts = [lines(focus, 0, F.lit(0.0), empty_string, F.concat(F.lit("## Focus Window: "), _sec("ref_t0"), F.lit(" – "), _sec("ref_t1"), F.lit("\n(The answer is located within this time window)"))), _timeline_lines(q, chosen, on)]

    ends = hydrated(deduplicated(edges, on), chosen, ("label", "t_start"), on)
    causal = ends.where(F.col("relation_type").isin(*CAUSAL)).join(q.where(intent("CAUSAL") | typed("reasoning")).select(*on), list(on), "left_semi")
    arrow = F.concat(F.lit("  ["), _sec("src_t_start"), F.lit("] "), "src_label", F.lit("\n    ──["), "relation_type", F.lit(", conf="), F.format_string("%.2f", "confidence"), F.lit("]──▶\n  ["), _sec("dst_t_start"), F.lit("] "), "dst_label", F.lit("\n    Reason: "), F.coalesce(F.col("reasoning"), F.lit("not specified")))
    parts.append(titled(lines(causal, 2, F.col("src_t_start"), F.concat("src", F.lit(" "), "dst"), arrow), 2, "Causal Relationships"))

    people = chosen.where("node_type = 'CharacterNode'")
    parts.append(titled(lines(people, 3, F.col("ord"), F.col("node_id"), F.concat(F.lit("  "), "label", F.lit(": "), F.coalesce(F.expr("nullif(canonical_description, '')"), F.col("label")), F.lit("\n    Appears at: "), F.coalesce(F.try_element_at("meta_extra", F.lit("appears_at")), F.lit("unknown")))), 3, "Characters"))

    shift = ends.where("relation_type = 'EMOTION_SHIFT'")
    parts.append(titled(lines(shift, 4, F.coalesce("disc", F.lit(0.0)), F.col("src"), F.concat(F.lit("  "), "src_label", F.lit(": "), F.coalesce(F.try_element_at("meta_extra", F.lit("from")), F.lit("?")), F.lit(" → "), F.coalesce(F.try_element_at("meta_extra", F.lit("to")), F.lit("?")), F.lit(" (at "), _sec("src_t_start"), F.lit(" → "), _sec("dst_t_start"), F.lit(")"))), 4, "Emotional Arc"))

    states = chosen.where("node_type = 'StateChangeNode'")
    parts.append(titled(lines(states, 5, F.col("t_start"), F.col("node_id"), F.concat(F.lit("  ["), _sec("t_start"), F.lit("] "), F.coalesce(F.try_element_at("meta_extra", F.lit("entity")), F.col("label")), F.lit(": "), F.coalesce("prev_state", F.lit("None")), F.lit(" → "), F.coalesce("next_state", F.lit("None")))), 5, "State Changes"))

    near = ends.where(F.col("relation_type").isin(*SPATIAL)).join(q.where(intent("SPATIAL")).select(*on), list(on), "left_semi")
    near = top_per_group(near, on, 15, F.col("eord"), F.col("src"), F.col("dst"))
    parts.append(titled(lines(near, 6, F.col("eord"), F.col("src"), F.concat(F.lit("  ["), _sec("src_t_start"), F.lit("] "), "src_label", F.lit(" "), F.replace(F.lower("relation_type"), F.lit("_"), F.lit(" ")), F.lit(" "), "dst_label")), 6, "Spatial Layout"))

    eps = chosen.where("node_type = 'EpisodeNode'").join(q.where(typed("summarization")).select(*on), list(on), "left_semi")
    summary = F.coalesce(F.concat(F.lit(" — "), F.left(F.expr("nullif(try_element_at(meta_extra, 'summary'), '')"), F.lit(100))), empty_string)
    parts.append(titled(lines(eps, 7, F.col("t_start"), F.col("node_id"), F.concat(F.lit("  ["), _sec("t_start"), F.lit("–"), _sec("t_end"), F.lit("] "), "label", summary)), 7, "Episode Summaries"))

    said = ends.where("relation_type = 'SPOKEN_BY'").groupBy(*on, F.col("src").alias("node_id")).agg(F.max_by(F.left("dst_label", F.lit(30)), "eord").alias("speaker"))
    talk = chosen.where("node_type = 'SpeechNode'").join(said, [*on, "node_id"], "left").withColumn("narrator", F.coalesce(F.try_element_at("meta_extra", F.lit("source")) == "narrator", F.lit(False)))
    talk = top_per_group(talk, on, 20, F.desc("narrator"), F.col("t_start"), F.col("node_id"), rank="rg_r")
    who = F.when(F.col("narrator"), "[NARRATOR]: ").otherwise(F.coalesce(F.concat("speaker", F.lit(": ")), empty_string))
    parts.append(titled(lines(talk, 8, F.col("rg_r"), empty_string, F.concat(F.lit("  ["), _sec("t_start"), F.lit("] "), who, F.lit('"'), "label", F.lit('"'))), 8, "Dialogue"))

    last = chosen.join(q.select(*on, "types"), list(on)).where(relevant(F.col("types"), F.col("node_type"))).groupBy(*on).agg(F.max("t_end").alias("rg_end"))
    ahead = chosen.where(F.col("node_type").isin("SceneNode", "EpisodeNode", "ActionNode")).join(q.where(intent("PROSPECTIVE")).select(*on), list(on), "left_semi").join(last, list(on), "left").where("rg_end is null or t_start > rg_end")
    ahead = top_per_group(ahead, on, 6, F.col("t_start"), F.col("node_id"))
    parts.append(titled(lines(ahead, 9, F.col("t_start"), F.col("node_id"), F.concat(F.lit("  ["), _sec("t_start"), F.lit("–"), _sec("t_end"), F.lit("] ["), "node_type", F.lit("] "), "label")), 9, "What Happens Next"))

    if include_edges:
        shown = top_per_group(ends.where(F.col("relation_type").isin(*EDGE_SECTION)), on, 40, F.col("eord"), F.col("src"), F.col("dst"))
        parts.append(titled(lines(shown, 10, F.col("eord"), F.col("src"), F.concat(F.lit("  ("), "src", F.lit(") ["), _sec("src_t_start"), F.lit("] "), F.left("src_label", F.lit(40)), F.lit(" ──"), "relation_type", F.lit("──▶ ("), "dst", F.lit(") ["), _sec("dst_t_start"), F.lit("] "), F.left("dst_label", F.lit(40)))), 10, "Graph Edges"))

    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    packed = F.array_sort(F.collect_list(F.struct("section", "o1", "o2", "line")))
    body = every.groupBy(*on).agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("body"))
    text = F.concat(
        F.lit("You are answering a question about a video. The following knowledge was extracted from the video:\n\n"), F.coalesce("body", empty_string), F.lit("\n\nQuestion: "), "question",
        F.lit("\n\nAnswer based on the above knowledge and the provided video frames. Cite specific timestamps as evidence where relevant."),
    )
    return q.join(body, list(on), "left").select(*on, text.alias("context"))
