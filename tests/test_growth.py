"""Steps whose cost must grow with the rows and not with their square."""

import contextlib
import io
import random
import time

from pyspark.sql import functions as F

from reelgraph import catalog
from reelgraph.operators import graph as G
from reelgraph.operators import intervals as I
from reelgraph.operators import matching as M
from reelgraph.operators import similarity as S
from reelgraph.plans import activation, build, prompts, walking
from tests.test_operators import nodes_of

SF = "/root/testdata/sf0.001"


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(True)
    return text.getvalue()


def test_precision_frames_grow_from_the_start(spark):
    rng = random.Random(3)
    rows = [(f"n{i}", rng.choice(["ClipNode", "SceneNode", "SceneNode"]), t, t, {"video_id": rng.choice("abc")}) for i, t in enumerate(rng.choice([5, 3700, 3700, 9000, 40000, -100]) + rng.randrange(50) for _ in range(200))]
    rows.append(("lone", "SceneNode", 7, 7, {"video_id": "d"}))
    p = build.precision(nodes_of(spark, rows))
    assert "unboundedfollowing" not in plan_of(p).lower()  # such a frame is summed anew for each row
    clips = [(m["video_id"], t) for _, kind, t, _, m in rows if kind == "ClipNode"]
    want = {n: min((float(abs(t - c)) for v, c in clips if v == m["video_id"]), default=999.0) for n, _, t, _, m in rows}
    assert {r["node_id"]: r["temporal_precision"] for r in p.collect()} == want


def test_clip_gap_frames_grow_from_the_start(spark):
    assert "unboundedfollowing" not in plan_of(catalog.nearest_clip_gap(spark, SF)).lower()


def test_window_overlap_frames_grow_from_the_start(spark):
    assert "unboundedfollowing" not in plan_of(catalog.window_overlap(spark, SF)).lower()


def quick(f, most=60.0):
    """What ``f`` gives; it must not take as long as all pairs would."""
    begun = time.time()
    out = f()
    assert time.time() - begun < most
    return out


def test_text_meets_scenes_around_it_alone(spark):
    n = spark.range(60_000).select(F.lit("v").alias("video_id"), F.col("id").cast("string").alias("node_id"), F.lit("OCRNode").alias("node_type"), (F.col("id") * 3 + 1.0).alias("a_t"))
    s = spark.range(60_000).select(F.lit("v").alias("video_id"), F.col("id").alias("k"), (F.col("id") * 3.0).alias("b_t0"), (F.col("id") * 3 + 2.0).alias("b_t1"))
    hits = lambda: I.first_containing(n, s, ["video_id", "node_id"], "k", ["video_id"]).where("k = cast(node_id as bigint)").count()
    assert quick(hits) == 60_000


def test_first_containing_where_scenes_overlap(spark):
    rng = random.Random(5)
    spans = [(k, float(t), float(t + rng.choice([0, 30, 200, 90_000]))) for k, t in enumerate(rng.randrange(2000) for _ in range(300))]
    points = [(i, rng.randrange(8000) / 4) for i in range(400)]
    got = I.first_containing(spark.createDataFrame(points, "i int, a_t double"), spark.createDataFrame(spans, "k int, b_t0 double, b_t1 double"), ["i"], "k", width=20.0)
    want = {i: min(ks) for i, t in points if (ks := [k for k, a, b in spans if a <= t <= b])}
    assert {r["i"]: r["k"] for r in got.collect()} == want
    assert "min(" in plan_of(got)  # a span over a whole bucket hides those after it


def test_speech_meets_characters_around_it_alone(spark):
    a = spark.range(40_000).select(F.lit("v").alias("video_id"), F.col("id").alias("i"), (F.col("id") * 9.0).alias("a_t0"), (F.col("id") * 9 + 5.0).alias("a_t1"))
    b = spark.range(40_000).select(F.lit("v").alias("video_id"), F.col("id").alias("k"), (F.col("id") * 9.0 + 4).alias("b_t0"), (F.col("id") * 9 + 7.0).alias("b_t1"))
    assert quick(lambda: I.longest_overlap(a, b, ["i"], "k", ["video_id"]).where("i = k and overlap = 1").count()) == 40_000


def test_variants_are_looked_up_once_for_each_text(spark):
    said = spark.range(40_000).select(F.col("id").alias("mention_id"), F.when(F.col("id") % 2 == 0, "large plate").otherwise("old plate").alias("description"))
    named = spark.range(40_000).select((F.col("id") + 5).alias("canonical_id"), F.col("id").alias("ord"), F.array(F.lit("old plate")).alias("description_variants"), F.lit("old plate").alias("canonical_description"))
    assert quick(lambda: M.by_variant(said, named).where("canonical_id = 5").count()) == 40_000


def test_speakers_are_matched_once_for_each_text(spark):
    scenes = spark.range(10_000).select(F.lit("v").alias("video_id"), F.col("id").alias("scene"), F.lit("old plate").alias("said"))
    people = spark.range(40_000).select(F.lit("v").alias("video_id"), F.col("id").cast("string").alias("node_id"), F.lit("the old plate").alias("description"), (F.col("id") + 1).alias("ord"))
    m = lambda: M.by_description(scenes, people, ["video_id", "scene"], ["video_id"], "said", "description", "ord").where("node_id = '0' and is_substring").count()
    assert quick(m) == 10_000


def test_merged_spans_hold_the_same_points(spark):
    rng = random.Random(9)
    spans = [(rng.choice("ab"), float(t), float(t + rng.randrange(9))) for t in (rng.randrange(300) for _ in range(60))]
    got = [tuple(r) for r in I.merged_spans(spark.createDataFrame(spans, "g string, b_t0 double, b_t1 double"), ["g"]).select("g", "b_t0", "b_t1").collect()]
    for g in "ab":
        for t in (x / 2 for x in range(620)):
            assert sum(a <= t <= b for h, a, b in got if h == g) == any(a <= t <= b for h, a, b in spans if h == g)


def test_frame_texts_meet_nodes_around_them_alone(spark):
    rows = [(f"n{i}", "OCRNode", t, t + d, {"label": label}) for i, (t, d, label) in enumerate([(0, 500, "long one"), (10, 5, "long one"), (20, 5, "short"), (400, 9, "short"), (405, 1, "short"), (100, 0, "abc")])]
    frames = spark.createDataFrame([(0, "v", 50.0), (1, "v", 50.0), (1, "v", 402.0), (1, "v", 9000.0)], "qid int, video_id string, ts double")
    f = walking.frame_texts(frames, nodes_of(spark, rows))
    want = {(0, 50.0): "long one | short", (1, 50.0): "long one | short", (1, 402.0): "long one | short", (1, 9000.0): "(no caption)"}
    assert {(r["qid"], r["ts"]): r["text"] for r in f.collect()} == want
    assert "rg_k" in plan_of(f)  # joined in buckets of time


def test_frames_of_windows_are_counted_without_pairs(spark):
    rng = random.Random(4)
    windows = [("v", f"w{i}", t, t + rng.randrange(400)) for i, t in enumerate(float(rng.randrange(9000)) for _ in range(40))]
    frames = [("v", f"f{i}", float(rng.randrange(9000))) for i in range(300)]
    w, f = spark.createDataFrame(windows, "video_id string, win_id string, t_start double, t_end double"), spark.createDataFrame(frames, "video_id string, frame_id string, ts double")
    want = {i: n for _, i, a, b in windows if (n := sum(a <= t <= b for _, _, t in frames))}
    assert {r["win_id"]: r["n_frames"] for r in prompts.scene_requests(w, f, listed=False).collect()} == want
    listed = prompts.scene_requests(w, f)
    assert {r["win_id"]: len(r["frames"]) for r in listed.collect()} == want and "rg_k" in plan_of(listed)


def test_many_vectors_go_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 4)
    monkeypatch.setattr(S, "MOST_ROWS", 40)
    v = spark.range(200).select("id", F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    assert {r["rg_blocks"] for r in S._blocks(v.select(F.col("id"), "embedding"), "id", "embedding", [])[0].groupBy().agg(F.countDistinct("bi").alias("rg_blocks")).collect()} == {8}


def test_links_of_blocks_make_the_components_of_all_pairs(spark):
    rng = random.Random(2)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)], "id int, embedding array<double>")
    pairs, links = S.similar_pairs(v, 0.9, "id"), S.similar_links(v, 0.9, "id")
    of = lambda p: {tuple(r) for r in G.components(p.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()}
    assert of(links) == of(pairs) and links.count() < pairs.count()


def test_what_overlaps_a_question_is_joined_by_time(spark):
    times = spark.createDataFrame([(1, "v", 0.0, 10.0), (1, "v", 5.0, 20.0), (2, "v", 90.0, 95.0)], "qid int, video_id string, s0 double, s1 double")
    nodes = spark.createDataFrame([("v", "a", 20.0, 30.0), ("v", "b", 21.0, 89.0), ("v", "c", 0.0, 100.0)], "video_id string, node_id string, t_start double, t_end double")
    got = activation._around(times, nodes, ["qid", "video_id"], ["video_id"])
    assert sorted((r["qid"], r["node_id"]) for r in got.collect()) == [(1, "a"), (1, "c"), (2, "c")]


def test_banners_and_characters_are_not_paired(spark):
    b = spark.range(30_000).select(F.lit("v").alias("video_id"), F.when(F.col("id") % 3 == 0, "ann lee").otherwise("bob ray").alias("name"), F.col("id").cast("double").alias("t_start"))
    a = spark.range(30_000).select(F.lit("v").alias("video_id"), F.when(F.col("id") < 29_000, "x").otherwise(F.concat(F.lit("y"), "id")).alias("node_id"), (F.col("id") * 0.9).alias("timestamp"))
    got = quick(lambda: M.named_characters(b, a, ["video_id"], gap=10_000.0).collect(), 40.0)
    assert sorted(tuple(r) for r in got) == [("v", "ann lee", "x", 10_000), ("v", "bob ray", "x", 20_000)]
    got = quick(lambda: M.named_characters(b, a.where("node_id = 'x' or timestamp > 26999"), ["video_id"], gap=10.0).collect(), 40.0)
    assert sorted(tuple(r) for r in got) == [("v", "ann lee", "x", 8704), ("v", "bob ray", "x", 17406)]


def test_named_characters_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "NAMES_AT_ONCE", 4)
    rng = random.Random(8)
    found_any = 0
    for gap in (0.1, 3.0, 40.0):
        names = [*(f"n{i}" for i in range(15)), None]
        b = [(rng.choice(["v", "w", None]), rng.choice(names), rng.choice([None, rng.randrange(-300, 3000) / 10, rng.randrange(-300, 3000) / 10])) for _ in range(300)]
        b += [("v", f"rare{i}", i * 30.0) for i in range(12)]
        a = [(rng.choice(["v", "w", None]), rng.choice([*"abcdefg", None]), rng.randrange(-300, 3000) / 10 if rng.random() < 0.95 else None) for _ in range(60)]
        hits = {}
        for v, n, t in b:
            for u, c, s in a:
                if v is not None and v == u and t is not None and s is not None and abs(t - s) <= gap:
                    hits.setdefault((v, n), {}).setdefault(c, set()).add(t)
        want = set()
        for (v, n), found in hits.items():
            best = sorted(((-len(ts), c or "", c) for c, ts in found.items()))
            if len(best) == 1 or -best[0][0] >= -2 * best[1][0]:
                want.add((v, n, best[0][2], -best[0][0]))
        got = M.named_characters(spark.createDataFrame(b, "video_id string, name string, t_start double"), spark.createDataFrame(a, "video_id string, node_id string, timestamp double"), ["video_id"], gap)
        assert {tuple(r) for r in got.collect()} == want
        found_any += len(want)
    assert found_any > 5


def test_first_containing_makes_no_pairs_where_scenes_overlap(spark):
    points = spark.range(30_000).select(F.col("id").alias("i"), (20 + F.col("id") / 3000).alias("a_t"))
    spans = spark.range(30_000).select((30_000 - F.col("id")).alias("k"), (F.col("id") / 2000).alias("b_t0"), (F.col("id") / 2000 + 35).alias("b_t1"))
    assert quick(lambda: I.first_containing(points, spans, ["i"], "k").where("k = 1 and b_t1 < 50").count(), 40.0) == 30_000


def test_first_containing_of_moments_and_edges(spark):
    rng = random.Random(6)
    at = [-64.0, -0.1, 0.0, 0.1, 0.3, 1e-7, 60.0, 64.0, 120.0, 3840.0, 245760.0, 245760.1]
    spans = [(g, k, *sorted((rng.choice(at), rng.choice(at)))) for g in ("a", "b", None) for k in range(25)] + [("c", 1, 0.3, 0.3)]
    points = [(i, rng.choice(["a", "b", "c", None]), rng.choice(at)) for i in range(300)]
    got = I.first_containing(spark.createDataFrame(points, "i int, g string, a_t double"), spark.createDataFrame(spans, "g string, k int, b_t0 double, b_t1 double"), ["i"], "k", ["g"])
    want = {(i, g, t, min(ks)) for i, g, t in points if g and (ks := [(k, a, b) for h, k, a, b in spans if h == g and a <= t <= b])}
    assert {(r["i"], r["g"], r["a_t"], (r["k"], r["b_t0"], r["b_t1"])) for r in got.collect()} == want
