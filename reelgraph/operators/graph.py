"""Graph operators over node and edge tables.

All take many groups (videos, questions) at once: ``on`` names the columns that divide them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CAUSAL, FAMILIES, SPATIAL
from ..shared import shared_dir
from .ranking import top_per_group


def nodes_in_window(nodes: DataFrame, t0: float, t1: float, buffer: float = 30.0) -> DataFrame:
    """Nodes that overlap a window; both conditions reach the scan."""
    return nodes.where((F.col("t_start") <= t1 + buffer) & (F.col("t_end") >= t0 - buffer))


def events_in_episode(nodes: DataFrame, t0: float, t1: float, kinds: Sequence[str]) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*kinds) & F.col("t_start").between(t0, t1)).orderBy("t_start", "node_id")


def first_neighbour(edges: DataFrame, relation: str, on: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """The first neighbour by edge order of every node: columns node, neighbour."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.where(F.col("relation_type") == relation).groupBy(*on, F.col(a).alias("node")).agg(F.min_by(b, "eord").alias("neighbour"))


def hydrated(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Edges with columns of both end points, prefixed src_ and dst_; edges without an end point go."""
    end = lambda side: nodes.select(*on, F.col("node_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    return edges.join(end("src"), [*on, "src"]).join(end("dst"), [*on, "dst"])


def causal_chains(edges: DataFrame, nodes: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    return hydrated(edges.where(F.col("relation_type").isin(*CAUSAL)), nodes, ("label", "t_start"), on).orderBy("src_t_start", "src", "dst")


def induced(edges: DataFrame, chosen: DataFrame, on: Sequence[str] = (), node: str = "node_id") -> DataFrame:
    """Edges with both end points among the chosen nodes, once per end points and type."""
    ids = chosen.select(*on, F.col(node).alias("rg_id")).distinct()
    out = edges
    for side in ("src", "dst"):
        out = out.join(ids.withColumnRenamed("rg_id", side), [*on, side], "left_semi")
    return deduplicated(out, on)


def deduplicated(edges: DataFrame, on: Sequence[str] = (), disc: bool = False) -> DataFrame:
    """The first edge of each pair of end points and type."""
    key = [*on, "src", "dst", "relation_type"] + ["disc"] * disc
    return top_per_group(edges, key, 1, F.col("eord"))


def _own(table: DataFrame, on: Sequence[str]) -> list[str]:
    """Those of the dividing columns that a table has; edges of a video serve all questions about it."""
    return [c for c in on if c in table.columns]


def with_parents(chosen: DataFrame, nodes: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Chosen node ids and the parents of those that have one."""
    up = chosen.join(nodes.select(*_own(nodes, on), "node_id", "parent_id"), [*_own(nodes, on), "node_id"]).where("parent_id is not null").select(*on, F.col("parent_id").alias("node_id"))
    return chosen.select(*on, "node_id").union(up).distinct()


def undirected(edges: DataFrame, relations: Sequence[str] | None = None, on: Sequence[str] = ()) -> DataFrame:
    """Edges in both directions: columns node, neighbour, and those of the edge."""
    e = edges if relations is None else edges.where(F.col("relation_type").isin(*relations))
    keep = [c for c in ("relation_type", "confidence", "eord") if c in e.columns]
    return e.select(*on, F.col("src").alias("node"), F.col("dst").alias("neighbour"), *keep).union(e.select(*on, F.col("dst").alias("node"), F.col("src").alias("neighbour"), *keep))


def expand(frontier: DataFrame, nodes: DataFrame, edges: DataFrame, family: str, k: int = 5, on: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best neighbours of each frontier node by edge and node confidence, over one family.

    ``entity`` also goes through a shared entity id, with confidence one.  ``is_new`` tells neighbours
    outside the frontier; ``k`` counts all, and parallel edges.  An unknown family gives no rows.
    """
    around = undirected(edges, FAMILIES.get(family, ()), on)
    if family == "entity":
        named = nodes.where("entity_id is not null").select(*on, F.col("node_id"), "entity_id", "ord")
        a = frontier.select(*on, "node_id").distinct().join(named, [*on, "node_id"]).select(*on, F.col("node_id").alias("node"), "entity_id")
        b = named.select(*on, F.col("node_id").alias("neighbour"), "entity_id", F.col("ord").alias("eord"))
        shared = a.join(b, [*on, "entity_id"]).where("node <> neighbour").select(*on, "node", "neighbour", F.lit("SAME_ENTITY").alias("relation_type"), F.lit(1.0).alias("confidence"), "eord")
        around = around.unionByName(shared)
    seen = frontier.select(*on, F.col("node_id").alias("node")).distinct()
    score = nodes.select(*on, F.col("node_id").alias("neighbour"), F.col("confidence").alias("node_confidence"))
    found = seen.join(around, [*on, "node"]).join(score, [*on, "neighbour"])
    best = top_per_group(found, [*on, "node"], k, F.desc("confidence"), F.desc("node_confidence"), F.col("eord"), F.col("neighbour"), rank="rank")
    inside = seen.select(*on, F.col("node").alias("neighbour"), F.lit(False).alias("rg_new"))
    return best.join(inside, [*on, "neighbour"], "left").withColumn("is_new", F.coalesce("rg_new", F.lit(True))).drop("rg_new")


def reach(roots: DataFrame, edges: DataFrame, depth: int, relations: Sequence[str] | None = None, on: Sequence[str] = (), both_ways: bool = True) -> DataFrame:
    """Nodes within ``depth`` steps and the step at which each is first reached (0 for the roots)."""
    own = _own(edges, on)
    if both_ways:
        step = undirected(edges, relations, own).select(*own, "node", "neighbour")
    else:
        step = (edges if relations is None else edges.where(F.col("relation_type").isin(*relations))).select(*own, F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    step = step.distinct()
    ring = roots.select(*on, "node_id").distinct()
    seen = ring.withColumn("hop", F.lit(0))
    # a ring depends on the ring before alone, so the plan grows with the depth and not with its power
    for hop in range(1, depth + 1):
        ring = ring.select(*on, F.col("node_id").alias("node")).join(step, [*own, "node"]).select(*on, F.col("neighbour").alias("node_id")).distinct()
        seen = seen.unionByName(ring.withColumn("hop", F.lit(hop)))
    return seen.groupBy(*on, "node_id").agg(F.min("hop").alias("hop"))


def reach_all(roots: DataFrame, edges: DataFrame, relations: Sequence[str] | None = None, on: Sequence[str] = ()) -> DataFrame:
    """As ``reach`` until nothing is added, however many steps that takes; rounds are checkpointed in the shared folder."""
    shared_dir(roots.sparkSession)
    own = _own(edges, on)
    step = undirected(edges, relations, own).select(*own, "node", "neighbour").distinct().checkpoint()
    seen = roots.select(*on, "node_id").distinct().withColumn("hop", F.lit(0)).checkpoint()
    ring, hop = seen, 0
    while True:
        hop += 1
        following = ring.select(*on, F.col("node_id").alias("node")).join(step, [*own, "node"]).select(*on, F.col("neighbour").alias("node_id")).distinct()
        ring = following.join(seen.select(*on, "node_id"), [*on, "node_id"], "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        if not ring.take(1):
            return seen
        seen = seen.unionByName(ring).checkpoint()


def spine_walk(roots: DataFrame, edges: DataFrame, hops: int, relation: str = "PRECEDES", on: Sequence[str] = (), directions: Sequence[str] = ("forward", "backward")) -> DataFrame:
    """Follow the first edge of a relation, up to ``hops`` steps each way; a missing one ends the walk."""
    start = roots.select(*on, F.col("node_id").alias("root"), F.lit(0).alias("step"), "node_id").distinct()
    out = start
    for direction in directions:
        following = first_neighbour(edges, relation, _own(edges, on), reverse=direction == "backward")
        here = start
        for i in range(1, hops + 1):
            here = here.select(*on, "root", F.col("node_id").alias("node")).join(following, [*_own(edges, on), "node"]).select(*on, "root", F.lit(i if direction == "forward" else -i).alias("step"), F.col("neighbour").alias("node_id"))
            out = out.unionByName(here)
    return out


def children(roots: DataFrame, edges: DataFrame, depth: int, on: Sequence[str] = (), relation: str = "CONTAINS") -> DataFrame:
    """Descendants down to a depth, with their level; a node reached by several ways has several rows."""
    own = _own(edges, on)
    down = edges.where(F.col("relation_type") == relation).select(*own, F.col("src").alias("node"), F.col("dst").alias("child"))
    here = roots.select(*on, F.col("node_id").alias("root"), "node_id")
    out = None
    for level in range(1, depth + 1):
        here = here.withColumnRenamed("node_id", "node").join(down, [*own, "node"]).select(*on, "root", F.col("child").alias("node_id"))
        ring = here.withColumn("level", F.lit(level))
        out = ring if out is None else out.unionByName(ring)
    return out


def entity_trace(nodes: DataFrame, on: Sequence[str] = (), first: int | None = None) -> DataFrame:
    """All appearances of each entity in order of time."""
    w = Window.partitionBy(*on, "entity_id").orderBy("t_start", "ord")
    rows = nodes.where("entity_id is not null").withColumn("position", F.row_number().over(w))
    return rows if first is None else rows.where(F.col("position") <= first)


def same_entity(nodes: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of nodes of one entity, the earlier first."""
    named = nodes.where("entity_id is not null")
    a = named.select(*on, "entity_id", F.col("node_id").alias("src"), F.col("ord").alias("rg_a"))
    b = named.select(*on, "entity_id", F.col("node_id").alias("dst"), F.col("ord").alias("rg_b"))
    return a.join(b, [*on, "entity_id"]).where("rg_a < rg_b").select(*on, "src", "dst", F.lit("SAME_ENTITY").alias("relation_type"))


def same_identity(seeds: DataFrame, characters: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Characters whose entity equals the seed's, null equal to null."""
    s = seeds.select(*[F.col(c).alias(f"rg_{c}") for c in on], F.col("node_id").alias("seed"), F.col("entity_id").alias("rg_e"))
    cond = F.col("rg_e").eqNullSafe(F.col("entity_id"))
    for c in on:
        cond = cond & (F.col(f"rg_{c}") == F.col(c))
    return characters.select(*on, "node_id", "entity_id").join(s, cond).select(*on, "seed", "node_id")


def components(links: DataFrame) -> DataFrame:
    """Component of each node of a list of links (a, b): the smallest node reachable, as columns node, label.

    Alternating stars: each round ties the larger neighbours of every node, then the smaller ones, to the
    smallest neighbour, so the rounds grow with the logarithm of a component's size and links never more
    than double.  The smallest neighbour is an aggregate that Spark forms before the shuffle; the joins on
    nodes with very many links are skewed sort-merge joins, which Spark splits at run time.
    """
    shared_dir(links.sparkSession)
    links = links.select("a", "b").checkpoint()  # two readers
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stars = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct().checkpoint()
    before = None
    while True:
        around = stars.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(stars.select("lo", "hi"))
        smallest = around.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("least"))
        large = around.where("other > node").join(smallest, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("least"))
        tied = large.join(smallest, "hi")
        stars = tied.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).union(tied.select("hi", "least")).where("hi <> lo").distinct().checkpoint()
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(stars.select(F.col("hi").alias("node"), F.col("lo").alias("rg_l")), "node", "left").select("node", F.coalesce("rg_l", "node").alias("label"))


def scene_detail(nodes: DataFrame, edges: DataFrame, t0: float, t1: float, most: int = 30) -> DataFrame:
    """What happens in a window: overlapping nodes with a note by type, in order of time.

    Episodes and videos are left out, and characters that last ten times the padded window.
    """
    lo, hi = t0 - 5.0, t1 + 5.0
    n = nodes.where((F.col("t_start") <= hi) & (F.col("t_end") >= lo) & ~F.col("node_type").isin("EpisodeNode", "VideoNode"))
    n = n.where((F.col("node_type") != "CharacterNode") | (F.col("t_end") - F.col("t_start") <= 10 * (hi - lo)))
    said = speakers(nodes, edges)
    note = (
        F.when((F.col("node_type") == "SpeechNode") & F.col("speaker").isNotNull(), F.concat(F.lit("by "), F.col("speaker")))
        .when(F.col("node_type") == "StateChangeNode", F.concat(F.coalesce("prev_state", F.lit("")), F.lit(" -> "), F.coalesce("next_state", F.lit(""))))
        .when(F.col("node_type") == "OCRNode", F.try_element_at("meta_extra", F.lit("semantic_type")) if "meta_extra" in nodes.columns else F.lit(None))
    )
    return n.join(said, "node_id", "left").withColumn("note", note).orderBy("t_start", "node_id").limit(most)


def speakers(nodes: DataFrame, edges: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Label of the speaker of each speech node."""
    first = first_neighbour(edges, "SPOKEN_BY", on).withColumnRenamed("node", "node_id")
    return first.join(nodes.select(*on, F.col("node_id").alias("neighbour"), F.col("label").alias("speaker")), [*on, "neighbour"]).drop("neighbour")


def by_type(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*kinds))


def episodes(nodes: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Episodes, numbered in order of time."""
    return by_type(nodes, "EpisodeNode").withColumn("position", F.row_number().over(Window.partitionBy(*on).orderBy("t_start", "node_id")))


def slices(nodes: DataFrame, edges: DataFrame, on: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The parts of a subgraph: events, state changes and speech numbered in order of time; characters; nodes with a
    keyframe; spatial edges."""
    timed = lambda n: n.withColumn("position", F.row_number().over(Window.partitionBy(*on).orderBy("t_start", "node_id")))
    return {
        "events": timed(nodes), "characters": by_type(nodes, "CharacterNode"), "state_changes": timed(by_type(nodes, "StateChangeNode")), "speech": timed(by_type(nodes, "SpeechNode")),
        "visual": nodes.where("keyframe_id is not null"), "spatial": edges.where(F.col("relation_type").isin(*SPATIAL)),
    }


def causal_neighbours(nodes: DataFrame, edges: DataFrame, on: Sequence[str] = (), parents: bool = False) -> DataFrame:
    """Causes (``parents``) or effects of each node: columns node, neighbour, relation_type."""
    a, b = ("dst", "src") if parents else ("src", "dst")
    e = edges.where(F.col("relation_type").isin(*CAUSAL)).select(*on, F.col(a).alias("node"), F.col(b).alias("neighbour"), "relation_type")
    return e.join(nodes.select(*on, F.col("node_id").alias("node")), [*on, "node"], "left_semi").distinct()


def point(nodes: DataFrame, node_id: str | Column) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)
