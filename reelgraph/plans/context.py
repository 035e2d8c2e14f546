"""Two-stage answering: assembling a bounded, chronological context from searches, and voting over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTEXT_STOP, keyword_hits, keywords
from ..operators.matching import option_characters
from ..operators.ranking import majority, ranked_then_by_time, top_per_group
from ..operators.windows import bucket_first, count_windows, gap_clusters, widened_clusters
from ..schema import CONTEXT_ROWS

V = ["video_id"]
ROWS_BESIDE_REFERENCE, ROWS_IN_RANGE, INTRO = 12, 30, (10.0, 30.0)


def reference_block(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes in each question's reference window, in order of time, thirty at most."""
    q = questions.where("ref_t0 is not null and ref_t1 - ref_t0 < 3600").select("qid", *V, "ref_t0", "ref_t1")
    j = q.join(nodes, V).where((F.col("t_start") <= F.col("ref_t1")) & (F.col("t_end") >= F.col("ref_t0")))
    return top_per_group(j, ["qid"], ROWS_IN_RANGE, F.col("t_start"), F.col("node_id")).select("qid", *V, "node_id").withColumn("block", F.lit(0))


def search_windows(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Windows around the first three clusters of each question's twenty best hits."""
    best = top_per_group(hits, ["qid"], 20, F.desc("score"), F.col("node_id")).join(nodes.select(*V, "node_id", "t_start", "t_end"), [*V, "node_id"])
    return widened_clusters(gap_clusters(best, ["qid", *V], "t_start", "t_end", ["node_id"]), ["qid", *V])


def introductions(options: DataFrame, characters: DataFrame) -> DataFrame:
    """Windows in which the characters that options name are introduced."""
    c = option_characters(options, characters, V)
    return c.select("qid", *V, F.greatest(F.lit(0.0), F.col("t_start") - INTRO[0]).alias("t0"), (F.col("t_start") + INTRO[1]).alias("t1"))


def assemble(questions: DataFrame, nodes: DataFrame, hits: DataFrame, windows: DataFrame, most: int = CONTEXT_ROWS) -> DataFrame:
    """Context rows of each question: the reference block, then what searches and windows found, ranked by
    the question's words, capped, and in order of time."""
    first = reference_block(questions, nodes)
    inside = windows.select("qid", *V, "t0", "t1").join(nodes.select(*V, "node_id", "t_start", "t_end"), V).where("t_start <= t1 and t_end >= t0").select("qid", *V, "node_id")
    other = hits.select("qid", *V, "node_id").unionByName(inside).distinct().join(first.select("qid", "node_id"), ["qid", "node_id"], "left_anti")
    sizes = first.groupBy("qid").agg(F.count("*").alias("rg_f"))
    asked = questions.select("qid", keywords("question", CONTEXT_STOP).alias("rg_k"))
    ranked = other.join(nodes, [*V, "node_id"]).join(asked, "qid").join(sizes, "qid", "left")
    score = F.when(F.size("rg_k") > 0, keyword_hits(F.col("rg_k"), "label") / F.size("rg_k")).otherwise(F.lit(0.0))
    room = F.when(F.col("rg_f").isNull(), F.lit(most)).otherwise(F.least(F.greatest(F.lit(0), F.lit(most) - F.col("rg_f")), F.lit(ROWS_BESIDE_REFERENCE)))
    ranked = ranked.withColumns({"rg_s": score, "rg_room": room})
    kept = top_per_group(ranked, ["qid"], F.col("rg_room"), F.desc("rg_s"), F.col("ord"), F.col("node_id")).select("qid", *V, "node_id").withColumn("block", F.lit(1))
    rows = first.unionByName(kept).join(nodes, [*V, "node_id"])
    return ranked_then_by_time(rows, ["qid"], most, F.col("block"), F.col("t_start"), F.col("node_id"))


def context_text(rows: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.format_string("%.0fs", "t_start"), F.lit("] "), F.regexp_replace("node_type", "Node$", ""), F.lit(": "), "label")
    packed = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return rows.groupBy("qid").agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("context"))


def frames_to_show(hits: DataFrame, budget: int = 8) -> DataFrame:
    """One moment per minute of the hits, the best first, in order of time."""
    mids = hits.withColumn("mid", (F.col("t_start") + F.col("t_end")) / 2).withColumn("rg_o", -F.col("score"))
    firsts = bucket_first(mids, ["qid"], F.floor(F.col("mid") / 60), ["rg_o", "node_id"])
    return ranked_then_by_time(firsts, ["qid"], budget, F.desc("score"), F.col("node_id"), time="mid")


def frame_batches(frames: DataFrame, size: int = 10, overlap: int = 2) -> DataFrame:
    return count_windows(frames, ["qid"], ["ts", "frame_id"], size, size - overlap, "keep")


def voted(answers: DataFrame) -> DataFrame:
    """One answer of the batches of each question."""
    return majority(answers, ["qid"], "answer", "batch")
