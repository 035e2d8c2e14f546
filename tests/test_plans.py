"""Walks and context assembly with stubs in place of models."""

from pyspark.sql import functions as F

from reelgraph.plans import agents, context, walking

from .test_operators import edges_of, nodes_of


def small(spark):
    n = nodes_of(spark, [("a", "ActionNode", 0, 1, {"label": "knife falls"}), ("b", "ActionNode", 5, 6, {"label": "bread cut"}), ("e", "EpisodeNode", 0, 100, {"label": "whole story"}), ("o", "OCRNode", 200, 201, {"label": "exit sign"})])
    return n, edges_of(spark, [("a", "b", "CAUSES"), ("e", "a", "CONTAINS")])


def test_walk_until_warranted(spark):
    n, e = small(spark)
    q = spark.createDataFrame([(1, "v", "Why was the bread cut?", ["causal reasoning"], None, False, None), (2, "v", "What is it?", [], None, False, None), (3, "v", "Why?", ["reasoning"], None, False, None)], "qid int, video_id string, question string, types array<string>, options map<string,string>, has_frames boolean, discriminated array<string>")
    active = spark.createDataFrame([(1, "v", "a"), (2, "v", "o")], "qid int, video_id string, node_id string")
    vectors = spark.createDataFrame([("v", "a", [1.0, 0.0]), ("v", "o", [0.0, 1.0])], "video_id string, node_id string, embedding array<float>")
    choose = lambda qs, ns: qs.select("qid", "video_id", F.when(F.col("qid") == 3, "STOP").otherwise("EXPAND").alias("action"), F.lit("causal").alias("relation"), F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("string").alias("option"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    answer = lambda qs, ns: qs.select("qid", F.lit("A").alias("letter"))
    walk = walking.seeded(q, active, n)
    assert {(r["qid"], r["node_id"]) for r in walk.nodes.collect()} == {(1, "a"), (2, "o"), (3, "e")}
    got = {r["qid"]: r for r in walking.run(walk, n, e, vectors, choose, answer, hops=1).collect()}
    assert (got[1]["hop"], got[1]["satisfied"]) == (1, True) and (got[2]["hop"], got[2]["satisfied"]) == (0, True)
    assert (got[3]["hop"], got[3]["satisfied"]) == (1, False)


def test_build_windows_and_frames(spark):
    r = spark.range(1).select(walking.build_window(F.lit("causal_edge"), F.lit(1)).alias("a"), walking.build_window(F.lit("entity_or_frame"), F.lit(3)).alias("b"), walking.build_window(F.lit("other"), F.lit(0)).alias("c")).first()
    assert (tuple(r["a"]), tuple(r["b"]), tuple(r["c"])) == ((60.0, 16), (80.0, 32), (30.0, 8))
    f = spark.createDataFrame([(1, float(i * 6), i) for i in range(40)], "qid int, ts double, added int")
    kept = walking.kept_frames(f).collect()
    assert len(kept) == 24 and sum(not r["archived"] for r in kept) == 10


def test_context_is_capped_and_chronological(spark):
    rows = [(f"n{i:02d}", "ActionNode", 10 * i, 10 * i + 1, {"label": "red knife" if i % 10 == 0 else "other"}) for i in range(60)]
    n = nodes_of(spark, rows)
    q = spark.createDataFrame([(1, "v", "Where is the knife?", None, None), (2, "v", "knife?", 100.0, 139.0)], "qid int, video_id string, question string, ref_t0 double, ref_t1 double")
    hits = n.crossJoin(spark.createDataFrame([(1,), (2,)], "qid int")).select("qid", "video_id", "node_id", F.lit(0.5).alias("score"))
    w = context.search_windows(hits, n)
    got = context.assemble(q, n, hits, w)
    one = [r for r in got.where("qid = 1").orderBy("position").collect()]
    assert len(one) == 40 and [r["t_start"] for r in one] == sorted(r["t_start"] for r in one) and {f"n{i:02d}" for i in range(0, 60, 10)} <= {r["node_id"] for r in one}
    two = got.where("qid = 2").collect()
    assert sum(r["block"] == 0 for r in two) == 4 and sum(r["block"] == 1 for r in two) == 12
    assert context.context_text(got).count() == 2


def test_agents_use_tools_until_they_answer(spark):
    n, _ = small(spark)
    q = spark.createDataFrame([(1, "v", "What falls?"), (2, "v", "never answers")], "qid int, video_id string, question string")

    def chat(talk):
        """Answers once a tool has shown the knife; the second question calls a tool that does not exist."""
        g = talk.groupBy("qid").agg(F.bool_or((F.col("role") == "tool") & F.contains("text", F.lit("knife falls"))).alias("shown"), F.bool_or(F.contains("text", F.lit("Answer now"))).alias("forced"), F.max("text").alias("t"))
        call = F.when(F.col("qid") == 1, "<function=search_graph><parameter=query>falling knife</parameter></function>").otherwise("<function=fly></function>")
        return g.select("qid", F.when(F.col("shown"), "B").when(F.col("forced"), "D").otherwise(call).alias("text"))

    got = {r["qid"]: (r["letter"], r["turn"]) for r in agents.run(q, n, chat, turns=2).collect()}
    assert got == {1: ("B", 2), 2: ("D", 3)}
    calls = agents.calls_of(spark.createDataFrame([(1, "Thought\nAction: get_scene_detail('0:00', 0:04)")], "qid int, text string"), "react").withColumn("video_id", F.lit("v"))
    assert agents.scene_detail(calls, n).first()["text"].split("\n") == ["[0s–1s] Action: knife falls", "[5s–6s] Action: bread cut"]
    assert agents.list_episodes(calls, n).first()["text"] == "[0s–100s] Episode: whole story"


def test_one_shot_and_two_stage_answers(spark):
    from reelgraph.plans import answering

    n = nodes_of(spark, [
        ("a", "ActionNode", 0, 1, {"label": "knife falls"}), ("b", "ActionNode", 5, 6, {"label": "bread cut"}), ("e", "EpisodeNode", 0, 1000, {"label": "whole story"}), ("o", "OCRNode", 200, 201, {"label": "exit sign"}),
        ("k1", "ClipNode", 300, 300, {"keyframe_id": "f300", "confidence": 0.5}), ("k2", "ClipNode", 310, 310, {"keyframe_id": "qs_310", "confidence": 0.1}),
    ])
    e = edges_of(spark, [("a", "b", "CAUSES"), ("e", "a", "CONTAINS")])
    frames = spark.createDataFrame([("v", f"f{t}", float(t), t % 7 / 7) for t in range(0, 1000, 5)] + [("v", "qs_310", 310.0, 0.0)], "video_id string, frame_id string, ts double, motion double")
    vectors = spark.createDataFrame([("v", "a", [1.0, 0.0]), ("v", "k1", [0.0, 1.0])], "video_id string, node_id string, embedding array<float>")
    q = spark.createDataFrame([
        (1, "v", "Why does the knife fall? (A) wind (B) bread", "['reasoning']", "00:00-00:08", "sport", [1.0, 0.0]), (2, "v", "What is shown?", "", "", "", [0.0, 1.0]), (3, "v", "Where?", "['entity recognition']", "03:00-08:00", "", [0.0, 1.0]),
    ], "qid int, video_id string, question string, question_type string, time_reference string, video_type string, embedding array<float>")
    p = {r["qid"]: r for r in answering.one_shot_prompts(q, n, e, vectors, frames).collect()}
    assert [f["frame_id"] for f in p[1]["frames"]] == ["f0", "f5"] and "knife falls" in p[1]["user"] and "Focus Window: 0s – 8s" in p[1]["user"]
    assert [f["frame_id"] for f in p[2]["frames"]] == ["f300"] and p[2]["intents"] == ["SEMANTIC"]
    # a window of five minutes with two stored frames: both are shown, the question's own sample too
    assert {f["frame_id"] for f in p[3]["frames"]} == {"f300", "qs_310"} and p[3]["subgraph_size"] == 4
    chat = lambda prompts: prompts.select("qid", F.when(F.contains("user", F.lit("knife")), "It is\nB").otherwise("A").alias("text"))
    got = {r["qid"]: r["answer"] for r in answering.answer_one_shot(answering.one_shot_prompts(q, n, e, vectors, frames), chat).collect()}
    assert got == {1: "B", 2: "A", 3: "A"}
    plan = lambda prompts: prompts.select("qid", F.when(F.col("qid") == 3, '{"windows": [{"t_start": 0, "t_end": 600}], "search_queries": ["knife"], "needs_frames": true, "reasoning": "r"}').otherwise("no json").alias("text"))
    asked = {r["qid"]: r["user"] for r in answering.planner_prompts(answering.parsed_questions(q), n).collect()}
    assert asked[1] == "[0s–1000s] Episode: whole story\n\n[Question type: reasoning]\n[Time reference: 00:00-00:08 (= 0s–8s from the start)]\nQuestion: Why does the knife fall? (A) wind (B) bread"
    plans = {r["qid"]: r for r in answering.plans(plan(q.select("qid")), q).collect()}
    assert plans[2]["search_queries"] == ["What is shown?"] and plans[3]["needs_frames"] and len(plans[3]["windows"]) == 1
    seen = []

    def answer(prompts):
        seen.extend(prompts.collect())
        return prompts.select("qid", F.when(F.contains("user", F.lit("Said of the frames before")), "B").otherwise("A").alias("text"))

    two = {r["qid"]: r for r in answering.answer_two_stage(q, n, frames, plan, answer).collect()}
    assert two[1]["answer"] == "A" and "knife falls" in two[1]["context"]
    assert two[3]["batch_answers"] == ["A", "B"] and two[3]["answer"] == "A"  # fourteen frames in two batches; ties to the first
    assert all(len(r["frames"]) <= 10 for r in seen) and sum(r["qid"] == 3 for r in seen) == 2


def test_walk_builds_what_it_lacks(spark):
    n, e = small(spark)
    q = spark.createDataFrame([(1, "v", "Who is it?", ["entity recognition"], None, False, None), (2, "v", "Why?", ["causal reasoning"], None, False, None)], "qid int, video_id string, question string, types array<string>, options map<string,string>, has_frames boolean, discriminated array<string>")
    n2 = nodes_of(spark, [("a", "ActionNode", 0, 1, {"label": "knife falls"}), ("b", "ActionNode", 5, 6, {"label": "bread cut"})])
    active = spark.createDataFrame([(1, "v", "a"), (2, "v", "a"), (2, "v", "b")], "qid int, video_id string, node_id string")
    vectors = spark.createDataFrame([], "video_id string, node_id string, embedding array<float>")
    frames = spark.createDataFrame([("v", f"f{t}", float(t), 0.1) for t in range(0, 100, 5)], "video_id string, frame_id string, ts double, motion double")
    record = '{"ocr_text": [{"text": "EXIT"}, {"text": " "}], "characters": [{"description": "tall man", "emotion": "calm"}], "actions": [{"description": "man walks", "approx_timestamp": 3.0}], "state_changes": [{"entity": "door", "from_state": "shut", "to_state": "open"}]}'
    builder = walking.Builder(frames, lambda p: p.select("qid", F.lit(record).alias("raw_json")), lambda p: p.select("video_id", "qid", F.lit(0).alias("pos"), F.lit("knife falls").alias("cause"), F.lit("bread cut").alias("effect"), F.lit("causes").alias("relation_type"), F.lit(0.9).alias("confidence")))
    choose = lambda qs, ns: qs.select("qid", "video_id", F.lit("BUILD").alias("action"), *[F.lit(None).cast("string").alias(c) for c in ("relation", "node_id", "option")], F.lit(None).cast("array<float>").alias("embedding"))
    logged = []
    none = e.where("false")
    got = {r["qid"]: r for r in walking.run(walking.seeded(q, active, n2), n2, none, vectors, choose, lambda qs, ns: qs.select("qid", F.lit("A").alias("letter")), hops=2, builder=builder, log=lambda d: logged.extend(d.collect())).collect()}
    assert got[1]["satisfied"] and got[1]["hop"] == 1  # a character was seen
    assert got[2]["satisfied"] and got[2]["hop"] == 1  # a causal edge was inferred
    assert {(r["qid"], r["action"]) for r in logged} == {(1, "BUILD"), (2, "BUILD")}
    m = walking.minted(spark.createDataFrame([(1, "v", 0.0, 10.0, record)], "qid int, video_id string, t0 double, t1 double, raw_json string"), 2).collect()
    assert {(r["label"], r["t_start"]) for r in m} == {("EXIT", 5.0), ("tall man", 5.0), ("man walks", 3.0), ("door: shut→open", 5.0)}


def test_frame_texts_and_frames_as_a_tool(spark):
    n, _ = small(spark)
    f = spark.createDataFrame([(1, "v", 2.0), (1, "v", 500.0)], "qid int, video_id string, ts double")
    got = {r["ts"]: r["text"] for r in walking.frame_texts(f, n).collect()}
    assert got == {2.0: "knife falls | whole story | bread cut", 500.0: "(no caption)"}
    frames = spark.createDataFrame([("v", f"f{t}", float(t), 0.1) for t in range(10)], "video_id string, frame_id string, ts double, motion double")
    calls = agents.calls_of(spark.createDataFrame([(1, "Action: extract_frames(3, 5)")], "qid int, text string"), "react").withColumn("video_id", F.lit("v"))
    assert agents.extract_frames(calls, frames).first()["text"].split("\n") == ["[t=3.0s] frame f3", "[t=4.0s] frame f4", "[t=5.0s] frame f5"]
