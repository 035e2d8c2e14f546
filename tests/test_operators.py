"""Small fixtures for functions and operators whose edges the tables do not show."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reelgraph.functions import text as T
from reelgraph.functions import vectors as V
from reelgraph.operators import aggregates as A
from reelgraph.operators import graph as G
from reelgraph.operators import intervals as I
from reelgraph.operators import matching as M
from reelgraph.operators import ranking as R
from reelgraph.operators import windows as W
from reelgraph.plans import activation, evaluation, serialization, warrant
from reelgraph.schema import EDGES, NODES
from reelgraph.sources import readers, writers


def nodes_of(spark, rows):
    """Nodes from (node_id, node_type, t_start, t_end, more)."""
    names = [f.split()[0] for f in NODES.replace("map<string,string>", "map").split(", ")]
    out = []
    for i, (node, kind, t0, t1, *more) in enumerate(rows):
        base = dict(video_id="v", node_id=node, ord=i, node_type=kind, label=node, level=0, t_start=float(t0), t_end=float(t1), confidence=1.0, temporal_precision=0.0, meta_extra={})
        base.update(more[0] if more else {})
        out.append(tuple(base.get(n) for n in names))
    return spark.createDataFrame(out, NODES)


def edges_of(spark, rows):
    names = [f.split()[0] for f in EDGES.replace("map<string,string>", "map").split(", ")]
    out = []
    for i, (src, dst, kind, *more) in enumerate(rows):
        base = dict(video_id="v", src=src, dst=dst, relation_type=kind, eord=i, weight=1.0, confidence=1.0, meta_extra={})
        base.update(more[0] if more else {})
        out.append(tuple(base.get(n) for n in names))
    return spark.createDataFrame(out, EDGES)


def column(df, name):
    return [r[name] for r in df.collect()]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_window_fixture(spark):
    n = nodes_of(spark, [(f"n{i}", "ClipNode", 60 * i, 60 * i + 30) for i in range(10)])
    starts = lambda a, b, buf: set(column(G.nodes_in_window(n, a, b, buf), "t_start"))
    assert 120.0 in starts(100, 140, 0) and 60.0 not in starts(100, 140, 0)
    assert 60.0 in starts(100, 140, 30) and not starts(10000, 20000, 30)


def test_interval_join_equals_nested_loop(spark):
    rng = random.Random(1)
    a = [(i, t, t + rng.choice([0, 1, 50, 5000])) for i, t in enumerate(rng.uniform(-500, 4000) for _ in range(120))]
    b = [(i, t, t + rng.choice([0, 3, 700, 1e9])) for i, t in enumerate(rng.uniform(0, 4000) for _ in range(80))] + [(99, None, 5.0), (98, 9.0, 1.0)]
    x = spark.createDataFrame([(i, float(s), float(e)) for i, s, e in a], "a int, a_t0 double, a_t1 double")
    y = spark.createDataFrame([(i, None if s is None else float(s), float(e)) for i, s, e in b], "b int, b_t0 double, b_t1 double")
    got = sorted((r["a"], r["b"]) for r in I.overlap_join(x, y, width=20.0, buffer=10.0).collect())
    assert got == sorted((i, j) for i, s, e in a for j, u, v in b if u is not None and u <= v and s - 10 <= v and e + 10 >= u)


def test_nearest_gap_both_ways(spark):
    n = nodes_of(spark, [("c", "ClipNode", 10, 10), ("s", "SceneNode", 15, 20), ("early", "SceneNode", 2, 3)])
    expected = {"c": 0.0, "s": 5.0, "early": 8.0}
    assert {r["node_id"]: r["gap"] for r in I.nearest_gap(n, F.col("node_type") == "ClipNode", "t_start", "ord", ["video_id"]).collect()} == expected
    assert {r["node_id"]: r["gap"] for r in I.nearest_gap_bucketed(n, F.col("node_type") == "ClipNode", "t_start", "ord", 4.0).collect()} == expected
    assert set(column(I.nearest_gap(n, F.lit(False), "t_start", "ord", ["video_id"]), "gap")) == {999.0}


def test_text_functions(spark):
    r = one(spark, T.seconds(F.lit("88:07")).alias("a"), T.seconds(F.lit("1:02:03")).alias("b"), T.seconds(F.lit("x")).alias("c"), T.cue_seconds(F.lit("01:00:02,5")).alias("d"), T.list_literal(F.lit("['a', 'b c']")).alias("e"))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (5287.0, 3723.0, None, 3602.5, ["a", "b c"])
    r = one(spark, T.time_range(F.lit("1:00:00-1:10")).alias("a"), T.clean_caption(F.lit(" <i>a</i>{x}  b ")).alias("b"), T.answer_letter(F.lit("A or maybe C.")).alias("c"), T.question_type(F.lit(" ['Reasoning']")).alias("d"))
    assert (tuple(r["a"]), r["b"], r["c"], r["d"]) == ((70.0, 3600.0), "a b", "C", "reasoning")
    r = one(spark, T.banner_name(F.lit("ANNA O'NEIL")).alias("a"), T.banner_name(F.lit("Route 66")).alias("b"), T.react_action(F.lit("Action: a(x)\nAction: find('q', 3)")).alias("c"), T.episode_label(F.lit("Episode 3"), F.lit("climax"), F.lit("It ends")).alias("d"))
    assert (r["a"], r["b"], r["c"]["name"], r["c"]["args"], r["d"]) == (True, False, "find", ["q", "3"], "Climax: It ends")
    df = spark.createDataFrame([('<think>{"no": 1}</think> so {"a": "}", "b": {"c": 1}} tail',), (None,), ("none",)], "t string")
    assert column(df.select(T.first_object("t").alias("x")), "x") == ['{"a": "}", "b": {"c": 1}}', None, None]
    calls = df.limit(1).select(T.tool_calls(F.lit("<function=search_graph><parameter=query>red car</parameter></function>")).alias("x")).first()["x"]
    assert [(c["name"], c["args"]) for c in calls] == [("search_graph", {"query": "red car"})]


def test_vector_functions(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    r = one(spark, V.cosine(a, b).alias("c"), V.normalized(a).alias("n"), V.similarity(a, b, "l2").alias("d"), V.histogram_distance(a, a).alias("h"), V.keyframes_of(F.lit(3.0)).alias("k"), V.tail_extended(F.lit(0.0), F.lit(60.0)).alias("t"))
    assert (round(r["c"], 6), r["n"], r["d"], r["k"], r["t"]) == (0.96, [0.6, 0.8], 2.0, 2, 120.0) and r["h"] < 0.01


def test_matching(spark):
    ev = spark.createDataFrame([("v", "n0", "person cooking soup", 0), ("v", "n1", "", 1), ("v", "n2", "person washing dirty dishes", 2)], "video_id string, node_id string, label string, ord int")
    q = spark.createDataFrame([("v", 1, "cooking soup"), ("v", 2, ""), ("v", 3, "dirty dishes person"), ("v", 4, "unrelated matter")], "video_id string, qid int, description string")
    assert {r["qid"]: r["node_id"] for r in M.event_by_description(q, ev, ["qid"], ["video_id"]).collect()} == {1: "n0", 3: "n2"}
    opts = spark.createDataFrame([("v", "A", "Anna"), ("v", "B", "nobody")], "video_id string, letter string, option_text string")
    ch = spark.createDataFrame([("v", "c", "Anna Smith", None, None, 0)], "video_id string, node_id string, label string, canonical_description string, entity_id string, ord int")
    assert [(r["letter"], r["node_id"]) for r in M.option_characters(opts, ch, ["video_id"]).collect()] == [("A", "c")]


def test_sequences(spark):
    app = spark.createDataFrame([("c", float(i), i, e) for i, e in enumerate(["happy", "unknown", "Happy ", "sad", ""])], "who string, timestamp double, ord int, emotion string")
    assert [(r["from_state"], r["to_state"], r["timestamp"]) for r in W.state_shifts(app, ["who"], ["timestamp"], "emotion").collect()] == [("happy", "sad", 3.0)]
    fifteen = spark.range(15).select(F.lit("s").alias("s"), "id")
    drop, keep = ({r["window_idx"] for r in W.count_windows(fifteen, ["s"], ["id"], tail=t).collect()} for t in ("drop", "keep"))
    assert drop == {0} and keep == {0, 1}
    assert W.pick_keyframes(list(map(float, range(60))), [1.0] + [0.0] * 58 + [1.0], 2, 5.0, 30.0) == [0, 29, 59]
    assert W.pick_keyframes([], [], 3, 1.0, 1.0) == []
    assert len(W.pick_keyframes(list(map(float, range(30))), [float(i % 7) for i in range(30)], 5, 0.0, 100.0)) <= 10
    picks = W.pick_keyframes(list(map(float, range(20))), [float(i * 7 % 5) for i in range(20)], 5, 5.0, 10.0)
    assert picks == sorted(picks)


def test_graph_operators(spark):
    n = nodes_of(spark, [("n0", "SceneNode", 0, 1, {"entity_id": "e"}), ("n1", "ClipNode", 1, 2, {"parent_id": "n0", "confidence": 0.5}), ("n2", "ClipNode", 2, 3, {"entity_id": "e"}), ("n3", "ClipNode", 3, 4)])
    e = edges_of(spark, [("n0", "n1", "CONTAINS"), ("n0", "n1", "PRECEDES"), ("n1", "n2", "PRECEDES"), ("n2", "n3", "OVERLAPS"), ("n0", "n1", "CONTAINS"), ("n0", "n2", "CAUSES", {"reasoning": "why"})])
    root = n.where("node_id = 'n0'").select("video_id", "node_id")
    assert column(G.children(root, G.deduplicated(e, ["video_id"]), 1, ["video_id"]), "node_id") == ["n1"]
    assert G.induced(e, n.where("node_id in ('n0', 'n1')"), ["video_id"]).count() == 2
    walked = {(r["step"], r["node_id"]) for r in G.spine_walk(root, e, 4, on=["video_id"]).collect()}
    assert walked == {(0, "n0"), (1, "n1"), (2, "n2")}  # an overlap breaks the spine
    got = G.expand(root, n, e, "entity", 5, ["video_id"]).collect()
    assert [(r["neighbour"], r["is_new"]) for r in got] == [("n2", True)] and not G.expand(root, n, e, "nothing").collect()
    assert {r["node_id"]: r["hop"] for r in G.reach_all(root, e, ("PRECEDES", "OVERLAPS"), ["video_id"]).collect()} == {"n0": 0, "n1": 1, "n2": 2, "n3": 3}
    chain = G.causal_chains(e, n, ["video_id"]).collect()
    assert [(c["relation_type"], c["reasoning"]) for c in chain] == [("CAUSES", "why")]
    pruned = R.budget_prune(n, ["video_id"], F.col("node_id") == "n1", 1)
    assert column(pruned, "node_id") == ["n1"]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a bigint, b bigint")
    assert {r["node"]: r["label"] for r in G.components(pairs).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_aggregates(spark):
    v = spark.createDataFrame([("q", a, i) for i, a in enumerate(["B", "A", "ERROR", "A", "B", ""])] + [("p", "ERROR", 0)], "qid string, a string, i int")
    assert {r["qid"]: r["a"] for r in R.majority(v, ["qid"], "a", "i").collect()} == {"q": "B", "p": "ERROR"}
    rec = spark.createDataFrame([("s", 0, [("Knife",), ("",)]), ("s", 1, [("knife ",), ("pan",), ("",)])], "s string, w int, items array<struct<label:string>>")
    assert [x["label"] for x in A.merged_windows(rec, ["s"], "items", "label", "w").first()["items"]] == ["Knife", "", "pan", ""]


def test_warrant_and_citations(spark):
    types = F.array(F.lit("['Causal Reasoning']"), F.lit("summarization"))
    assert one(spark, warrant.required_slots(types, F.lit(True)).alias("s"), warrant.required_slots(F.lit(None).cast("array<string>"), F.lit(False)).alias("n")) == (["causal_edge", "episode_summary", "mcq_option_coverage"], ["any_evidence"])
    n = nodes_of(spark, [("a", "ActionNode", 0, 1, {"label": "knife falls"}), ("b", "ActionNode", 2, 3), ("o", "OCRNode", 4, 5)]).withColumn("qid", F.lit(1))
    e = edges_of(spark, [("a", "b", "CAUSES")])
    q = spark.createDataFrame([(1, {"A": "the knife", "B": "a garden"}, False, None), (2, {"A": "knife"}, False, None)], "qid int, options map<string,string>, has_frames boolean, discriminated array<string>")
    facts = {r["qid"]: r for r in warrant.facts(q, n, e).collect()}
    assert facts[1]["causal_edge"] and facts[1]["entity_or_frame"] and facts[1]["missing_options"] == ["B"] and not facts[1]["temporal_occurrences"]
    assert not facts[2]["any_evidence"] and facts[2]["missing_options"] == ["A"]
    cov = warrant.coverage(warrant.facts(q, n, e).withColumn("slots", F.array(F.lit("causal_edge"), F.lit("mcq_option_coverage")))).collect()
    assert {r["qid"]: (r["coverage"], r["gaps"]) for r in cov} == {1: (0.5, ["mcq_option_coverage"]), 2: (0.0, ["causal_edge", "mcq_option_coverage"])}
    rows = [(1, "A", ["a"], ["reasoning"]), (1, "E", ["a"], []), (1, "B", ["zz"], []), (1, "C", ["b"], ["temporal grounding"]), (1, "D", ["b"], ["entity recognition"]), (1, "A", [], []), (2, "B", [], [])]
    ok = []
    for row in rows:
        a = spark.createDataFrame([(*row, False)], "qid int, letter string, cited array<string>, types array<string>, has_frames boolean")
        ok.append(warrant.verify(a, n, e).first()["ok"])
    assert ok == [True, False, False, False, False, True, False]
    assert one(spark, warrant.elasticity(F.lit("a "), F.lit("A")).alias("x"), warrant.elasticity(F.lit(None).cast("string"), F.lit("A")).alias("y")) == (0, 1)


def test_serialization_sections_in_order(spark):
    n = nodes_of(spark, [
        ("s0", "SceneNode", 0, 50, {"label": "kitchen"}), ("s1", "SceneNode", 50, 100, {"label": "garden"}), ("c", "CharacterNode", 0, 100, {"label": "Anna", "entity_id": "e"}), ("a", "ActionNode", 10, 11, {"label": "cuts", "confidence": 0.5}),
        ("b", "ActionNode", 60, 61, {"label": "falls"}), ("t", "SpeechNode", 12, 13, {"label": "hello"}), ("x", "StateChangeNode", 20, 20, {"label": "bread changes state", "prev_state": "whole", "next_state": "cut", "meta_extra": {"entity": "bread"}}),
    ]).withColumn("qid", F.lit(1))
    e = edges_of(spark, [("a", "b", "CAUSES", {"reasoning": "r", "confidence": 0.8}), ("t", "c", "SPOKEN_BY")]).withColumn("qid", F.lit(1))
    q = spark.createDataFrame([(1, "Why?", ["CAUSAL"], ["reasoning"], 0.0, 100.0, False)], "qid int, question string, intents array<string>, types array<string>, ref_t0 double, ref_t1 double, visual_provided boolean")
    text = serialization.serialize(q, n, e, include_edges=True).first()["context"]
    parts = ["## Focus Window: 0s – 100s", "## Timeline (grouped by segment)", "--- [0s–50s] kitchen ---", "[ActionNode] cuts (conf:0.50)", "--- [50s–100s] garden ---", "## Causal Relationships", "──[CAUSES, conf=0.80]──▶", "## Characters", "## State Changes", "bread: whole → cut", "## Dialogue", 'Anna: "hello"', "## Graph Edges", "Question: Why?"]
    places = [text.find(p) for p in parts]
    assert min(places) >= 0 and places == sorted(places), list(zip(parts, places))


def test_activation_keeps_seeds(spark):
    n = nodes_of(spark, [(f"n{i}", "ActionNode", i, i + 1, {"confidence": 0.1 * i}) for i in range(6)])
    e = edges_of(spark, [("n0", "n1", "CAUSES"), ("n1", "n2", "MOTIVATES"), ("n2", "n3", "PRECEDES"), ("n4", "n5", "CAUSES")])
    q = spark.createDataFrame([(1, "v", "Why did it fall?", ["CAUSAL"]), (2, "v", "x", ["SEMANTIC"])], "qid int, video_id string, question string, intents array<string>")
    seeds = spark.createDataFrame([(1, "v", "n0"), (2, "v", "n4")], "qid int, video_id string, node_id string")
    got = activation.activate(q, seeds, n, e).collect()
    assert {(r["qid"], r["node_id"]) for r in got} == {(1, "n0"), (1, "n1"), (1, "n2"), (2, "n4")}
    assert {(r["qid"], r["node_id"]) for r in got if r["is_seed"]} == {(1, "n0"), (2, "n4")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "movie.en.srt").write_text("1\r\n00:00:01,5 --> 00:00:02,000\r\n<i>Hello</i>\r\nthere\r\n\r\n2\r\n00:00:05,000 --> 00:00:04,000\r\nbad\r\n\r\n3\r\n0:00:06.25 --> 0:00:07.000\n{x}\n\n4\n00:01:00,1 --> 00:01:01,0\nEnd")
    cues = readers.subtitles(spark, str(tmp_path / "movie.en.srt")).orderBy("ord").collect()
    assert [(c["video_id"], c["start"], c["end"], c["text"]) for c in cues] == [("movie", 1.5, 2.0, "Hello there"), ("movie", 60.1, 61.0, "End")]
    n = nodes_of(spark, [("a", "ClipNode", 0, 1), ("b", "ClipNode", 1, 2)])
    e = edges_of(spark, [("a", "b", "PRECEDES"), ("a", "b", "PRECEDES"), ("a", "a", "EMOTION_SHIFT", {"disc": 1.0}), ("a", "a", "EMOTION_SHIFT", {"disc": 2.0})])
    writers.graph_tables(n, e, str(tmp_path / "g"))
    back = readers.tables(spark, str(tmp_path / "g"), "nodes", "edges")
    assert back["nodes"].count() == 2 and back["edges"].count() == 3
    text = writers.graph_documents(n, e).first()["value"]
    parsed = json.loads(text)
    assert parsed["video_id"] == "v" and [x["node_id"] for x in parsed["nodes"]] == ["a", "b"] and len(parsed["edges"]) == 3
    (tmp_path / "g.json").write_text(text)
    nodes, edges = readers.graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and edges.count() == 3 and set(column(nodes, "video_id")) == {"v"}
    (tmp_path / "q.csv").write_text('uid,video_path,question,question_type,time_reference,answer,type\n1,v,"Where is\nAnna with Bob?","[\'reasoning\']",00:10-00:20,A,film\n2,v,Who?,[],,B,film\n')
    q = readers.questions(spark, str(tmp_path / "q.csv"))
    assert column(readers.proper_nouns(q, "v"), "word") == ["Anna", "Bob", "Who"] and [(r["t0"], r["t1"]) for r in readers.time_references(q, "v").collect()] == [(10.0, 20.0)]
    log = str(tmp_path / "log")
    for _ in range(2):
        writers.answers(spark.createDataFrame([("1", "A")], "uid string, answer string"), log, spark)
    (tmp_path / "log" / "broken.json").write_text("not json\n")
    assert column(readers.answered_ids(spark, log), "uid") == ["1"]
    assert column(evaluation.unanswered(q, readers.answered_ids(spark, log)), "uid") == ["2"]
    scored = evaluation.scored(q, spark.createDataFrame([("1", "a"), ("2", "A")], "uid string, answer string"))
    m = {(r["scope"], r["key"]): (r["total"], r["correct"]) for r in evaluation.metrics(scored).collect()}
    assert m["overall", "all"] == (2, 1) and m["question_type", "reasoning"] == (1, 1)
    made = []
    for _ in range(2):
        writers.stage(spark, str(tmp_path / "stage"), lambda: made.append(1) or n)
    assert len(made) == 1
    frames = spark.createDataFrame([("v", f"f{i}", i, float(i), float(i % 4)) for i in range(10)], "video_id string, frame_id string, ord int, ts double, motion double")
    got = readers.window_frames(frames, 0.0, 9.0, 4, motion_rank=True)
    assert len(column(got, "ts")) == 4 and column(got, "ts") == sorted(column(got, "ts"))
    assert readers.window_frames(frames, 100.0, 101.0).count() == 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        n = nodes_of(spark, [(f"n{i}", "ClipNode", i % 3, i % 3 + 1, {"confidence": 0.5}) for i in range(20)]).repartition(int(partitions))
        assert sorted(column(R.budget_prune(n, ["video_id"], F.lit(False), 3), "node_id")) == ["n0", "n1", "n10"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
