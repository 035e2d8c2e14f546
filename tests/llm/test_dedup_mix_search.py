"""Near-duplicates, mixing and search against brute force."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from reelgraph.llm import components, simhash_dedup, source_mixing, topk_search

SPACES = r"[^\x20\x09-\x0D]+"


def brute_fingerprint(text):
    words = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_anchors_cover_one_flip():
    rng = np.random.default_rng(0)
    half = rng.integers(0, 1 << 32, 300, dtype=np.uint64)
    half = np.concatenate((half, [np.uint64(0), np.uint64(0xFFFFFFFF)]))
    home, _ = simhash_dedup.anchors(half)
    for bit in range(32):
        _, every = simhash_dedup.anchors(half ^ np.uint64(1 << bit))
        assert (every == home[:, None]).any(axis=1).all()


@pytest.mark.parametrize("run_rows", [200_000, 10])
def test_links_equal_brute_force(spark, monkeypatch, run_rows):
    monkeypatch.setattr(simhash_dedup, "RUN_ROWS", run_rows)
    rng = random.Random(run_rows)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(150):  # a dense group and chains around it
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    links, _ = simhash_dedup.class_links(spark.createDataFrame(rows, "rep bigint, fp bigint"))
    got = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ordered = sorted(fps)
    for i, j in itertools.combinations(range(len(ordered)), 2):
        if (ordered[i] ^ ordered[j]).bit_count() <= 3:
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    assert {i: find(i) for i in up} == {i: got.get(i, i) for i in up}


def test_components_of_a_chain(spark):
    rng = random.Random(2)
    order = list(range(300))
    rng.shuffle(order)
    links = [(a, b) for a, b in zip(order, order[1:])] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(300)) and got[1000] == got[1001] == 1000
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_edge_cases(spark, docs, texts, empty):
    more = docs.withColumn("fp", F.lit("clash")).union(docs.where("doc_id in (12, 20)").withColumn("fp", F.lit("again"))).union(docs.where("doc_id = 20").withColumn("doc_id", F.lit(None).cast("long")).withColumn("fp", F.lit("")))
    got = simhash_dedup.near_duplicates(more).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["fp"] % (1 << 64) == brute_fingerprint(texts[r["doc_id"]])
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}  # no words: one class
    kept = simhash_dedup.keep_one_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 3)").count() == 1
    assert simhash_dedup.near_duplicates(empty).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, live = sum(sizes.values()), {}, set(order)
    while live:
        share = sum(weight[s] for s in live)
        over = [s for s in live if total * weight[s] / share > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            live.discard(s)
        total = sum(sizes.values()) - sum(out.values())
    return out | {s: total * weight[s] / sum(weight[x] for x in live) for s in live}


def mixed_rows(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "a", "a", "b", "Z", "é", None])) for i in range(n)]


@pytest.mark.parametrize("n", [400, 3])
def test_mix_targets_and_takings(spark, n):
    rows = mixed_rows(n, 4) + [(None, None, "b"), (7, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    got = source_mixing.mix_sizes(df.select("doc_id", "text", "source")).collect()
    again = source_mixing.mix_sizes(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
        largest[s] = max(largest[s], len((t or "").split()))
    want = brute_targets(sizes)
    by_target = {round(v, 6) for v in want.values()}
    taken = defaultdict(int)
    for r in got:
        assert round(r["target"], 6) in by_target and r["taken"] <= 3 * r["size"]
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    for s, target in want.items():
        if list(want.values()).count(target) == 1:
            assert abs(taken[round(target, 6), sizes[s]] - target) <= largest[s]


def brute_mix(drawn, targets_by_source):
    """Copies of each row by the definition: levels by bisection, odds ratios ranked, words up to what is lacking."""
    copies = {}
    for source, target in targets_by_source.items():
        rows = [r for r in drawn if r["rg_source"] == source]
        total = sum(r["rg_size"] for r in rows)
        expected = lambda level: sum(min(3.0, level * r["rg_merit"]) * r["rg_size"] for r in rows)
        low, high = 0.0, 3.0
        for _ in range(200):
            low, high = (low, (low + high) / 2) if expected((low + high) / 2) >= target else ((low + high) / 2, high)
        e = {id(r): min(3.0, high * r["rg_merit"]) if total else 0.0 for r in rows}
        e = {k: float(round(v)) if abs(v - round(v)) < 1e-9 else v for k, v in e.items()}
        lack = target - sum(int(e[id(r)]) * r["rg_size"] for r in rows)

        def odds_ratio(r):
            u, p = (r["rg_draw"] + 0.5) / 2**52, e[id(r)] % 1
            return (u / (1 - u)) / (p / (1 - p))

        taken = 0
        for r in rows:
            copies[r["rg_id"]] = int(e[id(r)])
        for r in sorted((r for r in rows if e[id(r)] % 1 > 0), key=lambda r: (odds_ratio(r), r["rg_tie"])):
            if abs(taken + r["rg_size"] - lack) >= abs(taken - lack) and taken + r["rg_size"] > lack:
                break
            taken += r["rg_size"]
            copies[r["rg_id"]] += 1
    return copies


@pytest.mark.parametrize("seed, range_bits, broadcast", [(1, 14, 100_000), (2, 3, 100_000), (3, 14, 0)])
def test_mix_takes_what_brute_force_takes(spark, monkeypatch, seed, range_bits, broadcast):
    monkeypatch.setattr(source_mixing, "RANGE_BITS", range_bits)
    monkeypatch.setattr(source_mixing, "BROADCAST_ROWS", broadcast)
    rng = random.Random(seed)
    rows = [(i, "w " * int(rng.paretovariate(0.8) * 5 + rng.random()), rng.choice(["a", "a", "a", "b", "Z", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    drawn = source_mixing._drawn(df, "doc_id", "text", "source").withColumnRenamed("doc_id", "rg_id").collect()
    sizes = defaultdict(int)
    for r in drawn:
        sizes[r["rg_source"]] += r["rg_size"]
    got = source_mixing.mix_sizes(df).collect()
    want = brute_mix(drawn, brute_targets(sizes))
    assert {r["doc_id"]: r["copies"] for r in got} == want
    shares = defaultdict(set)
    for r in got:
        shares[next(x["rg_source"] for x in drawn if x["rg_id"] == r["doc_id"])].add(r["copies"])
    assert any(len(s) > 1 for s in shares.values())


def test_mix_chances_differ_and_null_ids_are_told_apart(spark):
    rows = [(None, "w " * (10 + i % 7) + str(i), "a") for i in range(400)] + [(i, "w " * 30, "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = source_mixing.mix_sizes(df).collect()
    a = [r for r in got if r["doc_id"] is None]
    assert abs(sum(r["taken"] for r in a) - a[0]["target"]) <= max(r["size"] for r in a)
    table, _ = source_mixing.plan(source_mixing._drawn(df, "doc_id", "text", "source"))
    assert len({r["rg_chance"] for r in table.where("rg_source = 'a'").collect()}) > 1


def test_mix_documents_repeats_rows(spark, empty, docs):
    mixed = source_mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    plan = {r["doc_id"]: r["copies"] for r in source_mixing.mix_sizes(docs).collect()}
    assert counts == {i: c for i, c in plan.items() if c}
    assert source_mixing.mix_sizes(empty).count() == 0 and source_mixing.mix_documents(empty).count() == 0


def test_mix_plan_is_native(docs, capsys):
    source_mixing.mix_sizes(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def brute_topk(rows, k=20, every=20):
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = defaultdict(list)
    for at, (q, v) in enumerate(ok):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(ok) if other != at)[:k]
            out[q].append([(i, -s) for s, i in found])
    return {q: sorted(lists) for q, lists in out.items()}


def lists_of(found, k=20):
    """Lists of each query, by rank; queries that share an id have several."""
    out = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("n, rows_a_ring", [(300, 4096), (300, 16), (15, 4096)])
def test_topk_equals_brute_force(spark, monkeypatch, n, rows_a_ring):
    monkeypatch.setattr(topk_search, "ANNULUS_ROWS", rows_a_ring)
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(n)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # one common vector, ties by id
    rows += [(40, [0.25] * 6), (40, rows[40][1]), (2120, [1.0, -1.0, 0.5]), (2140, [0.5] * 8)]
    rows += [(2000, None), (2020, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (2080, []), (2100, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = lists_of(topk_search.top_k(df))
    want = brute_topk(rows32)
    assert set(got) == set(want)
    for q, lists in want.items():
        assert sorted(got[q]) == sorted((rank, i, s) for found in lists for rank, (i, s) in enumerate(found, 1))


def test_topk_prunes(spark, monkeypatch):
    """Far clusters are excluded by the triangle inequality: few vectors are compared, with the same result."""
    monkeypatch.setattr(topk_search, "ANNULUS_ROWS", 40)
    monkeypatch.setattr(topk_search, "GROWTH", 2)
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(8)[i % 8] * 3 + rng.normal(scale=0.01, size=8)).round(3).tolist()) for i in range(1600)]
    searched = []
    got = lists_of(topk_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), searched=searched))
    want = brute_topk(rows)
    assert {q: [(i, s) for _, i, s in found] for q, found in got.items()} == {q: lists[0] for q, lists in want.items()}
    annuli = 1600 / 40
    assert searched[0] == len(want) and sum(searched) < 0.6 * len(want) * annuli


def test_topk_without_vectors(spark):
    assert topk_search.top_k(spark.createDataFrame([(20, None)], "vec_id bigint, embedding array<float>")).count() == 0


def test_topk_equals_sql(spark):
    import duckdb

    from reelgraph.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op6_topk"]).fetchall()
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op6_topk(spark, sf).collect()]
    assert len(got) == len(want) and sorted(got) == sorted(want)
