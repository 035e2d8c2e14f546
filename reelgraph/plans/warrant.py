"""When an answer is warranted: required slots, coverage, elasticity, and checks of citations.

All functions take tables keyed by question (``on``) and work on all questions at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keywords, question_type
from ..operators.aggregates import repeated_occurrences
from ..operators.graph import induced
from ..schema import CAUSAL, SLOT_TYPES, SLOTS


def _is(types: Column, kind: str) -> Column:
    return F.arrays_overlap(types, F.array(*map(F.lit, SLOT_TYPES[kind])))


def required_slots(types: Column, mcq: Column) -> Column:
    """Slots of a question by its types (folded), plus the options; any evidence if there are none."""
    folded = F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: question_type(t))
    named = [F.when(_is(folded, kind), F.lit(slot)) for kind, slot in SLOTS.items()] + [F.when(mcq, F.lit("mcq_option_coverage"))]
    slots = F.array_compact(F.array(*named))
    return F.when(F.size(slots) > 0, slots).otherwise(F.array(F.lit("any_evidence")))


def facts(questions: DataFrame, chosen: DataFrame, edges: DataFrame, on: Sequence[str] = ("qid",)) -> DataFrame:
    """What the chosen nodes of each question offer, a boolean per slot, and the options without evidence.

    ``questions`` has ``options`` (letter to text), ``has_frames`` and ``discriminated`` (letters).
    """
    inner = induced(edges, chosen, on) if set(on) <= set(edges.columns) else _induced_by(edges, chosen, on)
    causal = inner.where(F.col("relation_type").isin(*CAUSAL)).select(*on).distinct().withColumn("causal_edge", F.lit(True))
    kinds = chosen.groupBy(*on).agg(F.bool_or(F.col("node_type").isin("OCRNode", "CharacterNode")).alias("named"), F.bool_or(F.col("node_type") == "EpisodeNode").alias("episode_summary"))
    said = F.lower(F.concat_ws(" ", "label", "canonical_description"))
    options = questions.select(*on, "discriminated", F.explode("options").alias("letter", "option"))
    options = options.where(~F.array_contains(F.coalesce("discriminated", F.array().cast("array<string>")), F.col("letter"))).withColumn("rg_k", keywords("option")).where(F.size("rg_k") > 0)
    words = options.select(*on, "letter", F.explode("rg_k").alias("rg_w"))
    texts = chosen.select(*on, said.alias("rg_t"))
    hit = words.join(texts, list(on)).where(F.contains("rg_t", F.col("rg_w"))).select(*on, "letter").distinct()
    missing = options.join(hit, [*on, "letter"], "left_anti").groupBy(*on).agg(F.array_sort(F.collect_list("letter")).alias("missing_options"))
    out = questions.join(kinds, list(on), "left").join(causal, list(on), "left").join(repeated_occurrences(chosen, on), list(on), "left").join(missing, list(on), "left")
    no = F.lit(False)
    return out.withColumns({
        "any_evidence": F.col("named").isNotNull() | F.coalesce("has_frames", no), "entity_or_frame": F.coalesce("named", no) | F.coalesce("has_frames", no), "causal_edge": F.coalesce("causal_edge", no),
        "temporal_occurrences": F.coalesce("temporal_occurrences", no), "episode_summary": F.coalesce("episode_summary", no), "mcq_option_coverage": F.col("missing_options").isNull(),
        "missing_options": F.coalesce("missing_options", F.array().cast("array<string>")),
    }).drop("named")


def _induced_by(edges: DataFrame, chosen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Edges of one graph inside the chosen nodes of each question."""
    a = chosen.select(*on, F.col("node_id").alias("src"))
    b = chosen.select(*on, F.col("node_id").alias("dst"))
    return edges.join(a, "src").join(b, [*on, "dst"])


def coverage(slotted: DataFrame, on: Sequence[str] = ("qid",)) -> DataFrame:
    """Share of filled slots and the unfilled ones in order; ``slots`` and a boolean per slot in, 1 without slots."""
    flags = F.create_map(*[x for s in (*SLOTS.values(), "mcq_option_coverage", "any_evidence") if s in slotted.columns for x in (F.lit(s), F.coalesce(F.col(s), F.lit(False)))])
    gaps = F.filter("slots", lambda s: ~F.coalesce(F.try_element_at(flags, s), F.lit(False)))
    share = F.when(F.size("slots") > 0, (F.size("slots") - F.size(gaps)) / F.size("slots")).otherwise(F.lit(1.0))
    return slotted.withColumns({"coverage": share, "gaps": gaps})


def elasticity(full: Column, ablated: Column) -> Column:
    """0 if the answer stays when the last ring of evidence goes, else 1; 1 if either is missing."""
    return F.when(full.isNull() | ablated.isNull(), 1).when(F.upper(F.trim(full)) == F.upper(F.trim(ablated)), 0).otherwise(1)


def satisfied(theta: float = 1.0) -> Column:
    return (F.col("coverage") >= theta) & (F.col("elasticity") == 0)


def citations_inside(cited: DataFrame, chosen: DataFrame, on: Sequence[str] = ("qid",)) -> DataFrame:
    """Are all cited nodes among the chosen ones of the question?"""
    each = cited.select(*on, F.explode_outer("cited").alias("node_id"))
    known = chosen.select(*on, "node_id").distinct().withColumn("rg_in", F.lit(True))
    return each.join(known, [*on, "node_id"], "left").groupBy(*on).agg(F.bool_and(F.col("node_id").isNull() | F.col("rg_in").isNotNull()).alias("ok"))


def verify(answers: DataFrame, chosen: DataFrame, edges: DataFrame, on: Sequence[str] = ("qid",)) -> DataFrame:
    """Accept or reject answers (letter, cited, types, has_frames), with the reason."""
    cited = answers.select(*on, F.array_distinct(F.filter(F.coalesce("cited", F.array().cast("array<string>")), lambda c: F.length(c) > 0)).alias("cited"))
    inside = citations_inside(cited, chosen, on).withColumnRenamed("ok", "grounded")
    ids = cited.select(*on, F.explode("cited").alias("node_id"))
    found = ids.join(chosen, [*on, "node_id"]).groupBy(*on).agg(F.count_if(F.col("t_start").isNotNull()).alias("timed"), F.bool_or(F.col("node_type").isin("OCRNode", "CharacterNode")).alias("named"))
    inner = _induced_by(edges.where(F.col("relation_type").isin(*CAUSAL)), chosen, on)
    ends = inner.select(*on, F.explode(F.array("src", "dst")).alias("node_id"))
    causal = ids.join(ends, [*on, "node_id"]).select(*on).distinct().withColumn("causal", F.lit(True))
    some = chosen.select(*on).distinct().withColumn("evidence", F.lit(True))
    j = answers.drop("cited").join(cited, list(on))
    for part in (inside, found, causal, some):
        j = j.join(part, list(on), "left")
    types = F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    no = F.lit(False)
    frames = F.coalesce("has_frames", no)
    reason = (
        F.when(~F.coalesce(F.upper("letter").isin("A", "B", "C", "D"), no), "no valid letter")
        .when(~F.col("grounded"), "cited nodes were not retrieved")
        .when((F.size("cited") == 0) & ~frames & F.col("evidence").isNull(), "no citations and no evidence")
        .when(F.size("cited") == 0, F.lit(None))
        .when(_is(types, "causal"), F.when(F.col("causal").isNull(), "no cited node lies on a causal edge"))
        .when(_is(types, "temporal"), F.when(F.coalesce("timed", F.lit(0)) < 2, "two timed nodes must be cited"))
        .when(_is(types, "entity"), F.when(~frames & ~F.coalesce("named", no), "a text or character must be cited"))
    )
    return j.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).select(*on, "letter", "ok", "reason")
