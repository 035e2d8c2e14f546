"""Every query of the catalogue against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from reelgraph import catalog, catalog_graph  # noqa: F401  the second one adds to the first

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLES[name]).df()
    key = lambda r: tuple(x or "" for x in r)
    a, b = rows_of(got), rows_of(want)
    assert a[0] == b[0] and sorted(a[1], key=key) == sorted(b[1], key=key)


def rows_of(df):
    columns = sorted(df.columns)
    out = []
    for r in df[columns].itertuples(index=False):
        out.append(tuple(None if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x) for x in r))
    return columns, out


def naive_keyframes(times, score, k, min_gap, max_gap):
    """By the definition: the best scores apart from each other, then the middle of the widest gap that holds a row."""
    taken = []
    for i in sorted(range(len(times)), key=lambda i: (-score[i], i)):
        if len(taken) < k and all(abs(times[i] - times[j]) >= min_gap for j in taken):
            taken.append(i)
    while True:
        edges = sorted([times[0], times[-1], *(times[i] for i in taken)])
        wide = sorted((x - y, y, x) for y, x in ((a, b) for a, b in zip(edges, edges[1:])) if x - y > max_gap)
        options = [(-gap, lo, hi) for gap, lo, hi in wide if any(lo < times[i] < hi for i in range(len(times)))]
        if not options:
            return sorted(taken)
        _, lo, hi = min(options)
        taken.append(min((i for i in range(len(times)) if lo < times[i] < hi), key=lambda i: (abs(times[i] - (lo + hi) / 2), i)))


def test_greedy_keyframes_equal_a_naive_choice(spark):
    n = catalog.event_nodes(spark, SF).select("t_start", "node_id", "ord", "confidence").collect()
    want, by_day = set(), {}
    for r in sorted(n, key=lambda r: (r["t_start"], r["ord"])):
        by_day.setdefault(int(r["t_start"] // 86400), []).append(r)
    for day, rows in by_day.items():
        want |= {(day, rows[i]["node_id"]) for i in naive_keyframes([r["t_start"] for r in rows], [r["confidence"] for r in rows], 8, 3600.0, 14400.0)}
    got = catalog.greedy_keyframes(spark, SF).collect()
    assert {(r["day"], r["node_id"]) for r in got} == want and len(got) == len(want)


def test_entry(spark):
    assert 0 < __spark_entry__.entry(spark).count() <= 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_jaccard_of_all_parts(spark):
    parts = {r["p_partkey"]: {w for w in r["p_name"].lower().split() if len(w) > 3} for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    rows = catalog.token_jaccard(spark, SF).collect()
    of_class = {}
    for k in {(r["p_partkey"], r["class"]) for r in rows}:
        of_class.setdefault(k[1], set()).add(k[0])
    got = {(r["p_partkey"], b) for r in rows for b in of_class[r["like_class"]] if r["p_partkey"] < b}
    want = {(a, b) for a, x in parts.items() for b, y in parts.items() if a < b and x | y and len(x & y) / len(x | y) >= 0.4}
    assert got == want and max(b for _, b in got) > 60


def test_identity_and_spine_of_all_rows(spark):
    customers, orders = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("customer", "orders"))
    assert catalog.null_safe_identity(spark, SF).select("node_id").distinct().count() == customers
    assert catalog.spine_walk(spark, SF).select("root").distinct().count() == orders
