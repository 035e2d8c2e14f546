"""Queries over the test tables, one for each group of operators, and the SQL that gives the same rows.

The tables stand in for graphs: events are timed nodes (a ``view`` plays the clip), customers, orders
and parts are hierarchies and edges, documents and conversations are texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import aggregates as A
from .operators import graph as G
from .operators import intervals as I
from .operators import matching as M
from .operators import ranking as R
from .operators import similarity as S
from .operators import windows as W
from .plans import activation, evaluation, serialization, warrant

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Events as nodes: start in seconds after the first event, end by their value, confidence by it too."""
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    limits = e.agg(F.min("us").alias("us0"), F.max("value").alias("top"))  # one row
    e = e.crossJoin(F.broadcast(limits))
    start = (F.col("us") - F.col("us0")) / 1e6
    return e.select(
        F.concat(F.lit("ev_"), F.col("event_id")).alias("node_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("node_type"), F.col("event_type").alias("label"),
        start.alias("t_start"), (start + F.col("value")).alias("t_end"), F.concat(F.lit("u_"), F.col("user_id")).alias("entity_id"), (F.col("value") / F.col("top")).alias("confidence"), "value", "user_id",
    )


NODES = """nodes AS (SELECT 'ev_' || event_id AS node_id, event_id AS ord, event_type AS node_type, event_type AS label,
 (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS t_start,
 (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 + value AS t_end,
 'u_' || user_id AS entity_id, value / (SELECT max(value) FROM events) AS confidence, value, user_id FROM events)"""
#: Successive events of a user: the edges of the event graph.
SUCCESSORS = f"""{NODES}, edges AS (SELECT src, dst, eord, CASE WHEN t_end <= nt THEN 'PRECEDES' ELSE 'OVERLAPS' END AS relation_type, confidence FROM
 (SELECT node_id AS src, lead(node_id) OVER w AS dst, lead(t_start) OVER w AS nt, t_end, ord AS eord, confidence FROM nodes WINDOW w AS (PARTITION BY user_id ORDER BY t_start, ord)) WHERE dst IS NOT NULL)"""


def event_edges(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t_start", "ord")
    e = nodes.select(F.col("node_id").alias("src"), F.lead("node_id").over(w).alias("dst"), F.lead("t_start").over(w).alias("nt"), "t_end", F.col("ord").alias("eord"), "confidence").where("dst is not null")
    return e.select("src", "dst", "eord", F.when(F.col("t_end") <= F.col("nt"), "PRECEDES").otherwise("OVERLAPS").alias("relation_type"), "confidence")


@query(f"""WITH {NODES}, hit AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, node_id) AS rn FROM nodes WHERE t_start <= 172830 AND t_end >= 86370),
 clips AS (SELECT t_start AS c FROM nodes WHERE node_type = 'view')
 SELECT node_id, node_type, t_start, t_end, confidence, (SELECT min(abs(c - t_start)) FROM clips) AS gap, row_number() OVER (ORDER BY t_start, node_id) AS position FROM hit WHERE rn <= 40""")
def window_overlap(spark, d):
    nodes = event_nodes(spark, d)
    gaps = I.nearest_gap_bucketed(nodes, F.col("node_type") == "view", "t_start", "ord").select("node_id", "gap")
    best = G.nodes_in_window(nodes, 86400.0, 172800.0).orderBy(F.desc("confidence"), "node_id").limit(40)
    rows = best.join(gaps, "node_id")
    return rows.withColumn("position", F.row_number().over(Window.orderBy("t_start", "node_id"))).select("node_id", "node_type", "t_start", "t_end", "confidence", "gap", "position")


HOURS = "hours AS (SELECT h AS hour, h * 3600.0 AS b_t0, h * 3600.0 + 1800.0 AS b_t1 FROM range(0, 720) t(h))"


def hours(spark):
    return spark.range(0, 720).select(F.col("id").alias("hour"), (F.col("id") * 3600.0).alias("b_t0"), (F.col("id") * 3600.0 + 1800.0).alias("b_t1"))


def as_spans(nodes: DataFrame, side: str, *keep: str) -> DataFrame:
    return nodes.select(*keep, F.col("t_start").alias(f"{side}_t0"), F.col("t_end").alias(f"{side}_t1"))


@query(f"WITH {NODES}, {HOURS} SELECT node_id, hour FROM nodes JOIN hours ON t_start - 30 <= b_t1 AND t_end + 30 >= b_t0")
def window_overlap_many(spark, d):
    return I.overlap_join(as_spans(event_nodes(spark, d), "a", "node_id"), hours(spark), width=900.0, buffer=30.0, longest=7200.0).select("node_id", "hour")


@query(f"WITH {NODES} SELECT node_id, day FROM nodes JOIN (SELECT h AS day, h * 86400.0 AS b_t0, (h + 1) * 86400.0 AS b_t1 FROM range(0, 30) t(h)) ON t_start BETWEEN b_t0 AND b_t1 WHERE node_type IN ('click', 'purchase')")
def event_in_session(spark, d):
    days = spark.range(0, 30).select(F.col("id").alias("day"), (F.col("id") * 86400.0).alias("b_t0"), ((F.col("id") + 1) * 86400.0).alias("b_t1"))
    points = event_nodes(spark, d).where(F.col("node_type").isin("click", "purchase")).select("node_id", F.col("t_start").alias("a_t"))
    return I.containing_join(points, days, width=21600.0, longest=86400.0).select("node_id", "day")


@query(f"""WITH {NODES}, spans AS (SELECT h AS span, h * 1800.0 AS b_t0, h * 1800.0 + 7200.0 AS b_t1 FROM range(0, 1440) t(h))
 SELECT node_id, span FROM (SELECT node_id, span, row_number() OVER (PARTITION BY node_id ORDER BY span) AS rn FROM nodes JOIN spans ON t_start BETWEEN b_t0 AND b_t1) WHERE rn = 1""")
def first_containing_window(spark, d):
    spans = spark.range(0, 1440).select(F.col("id").alias("span"), (F.col("id") * 1800.0).alias("b_t0"), (F.col("id") * 1800.0 + 7200.0).alias("b_t1"))
    return I.first_containing(event_nodes(spark, d).select("node_id", F.col("t_start").alias("a_t")), spans, ["node_id"], "span", width=1800.0, longest=7200.0).select("node_id", "span")


@query(f"""WITH {NODES}, clips AS (SELECT t_start AS c FROM nodes WHERE node_type = 'view'),
 b AS (SELECT node_id, t_start, c FROM nodes ASOF LEFT JOIN clips ON t_start >= c), f AS (SELECT node_id, t_start, c FROM nodes ASOF LEFT JOIN clips ON t_start <= c)
 SELECT b.node_id, coalesce(least(b.t_start - b.c, f.c - b.t_start), 999.0) AS gap FROM b JOIN f ON b.node_id = f.node_id""")
def nearest_clip_gap(spark, d):
    return I.nearest_gap_bucketed(event_nodes(spark, d), F.col("node_type") == "view", "t_start", "ord").select("node_id", "gap")


@query(f"WITH {NODES} SELECT a.node_id AS src, b.node_id AS dst FROM nodes a JOIN nodes b ON a.user_id = b.user_id AND a.ord < b.ord AND abs(a.t_start - b.t_start) <= 120")
def band_join_actions(spark, d):
    n = event_nodes(spark, d)
    a = n.select("user_id", F.col("node_id").alias("src"), F.col("ord").alias("oa"), F.col("t_start").alias("a_t"))
    b = n.select("user_id", F.col("node_id").alias("dst"), F.col("ord").alias("ob"), F.col("t_start").alias("b_t"))
    return I.band_join(a, b, 120.0, ["user_id"]).where("oa < ob").select("src", "dst")


@query(f"""WITH {NODES}, {HOURS}, j AS (SELECT node_id, hour, least(t_end, b_t1) - greatest(t_start, b_t0) AS overlap FROM nodes JOIN hours ON t_start <= b_t1 AND t_end >= b_t0)
 SELECT node_id, hour, round(overlap, 3) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY overlap DESC, hour) AS rn FROM j WHERE overlap > 0) WHERE rn = 1""")
def overlap_argmax(spark, d):
    j = I.longest_overlap(as_spans(event_nodes(spark, d), "a", "node_id"), hours(spark), ["node_id"], "hour", width=900.0, longest=7200.0)
    return j.select("node_id", "hour", F.round("overlap", 3).alias("overlap"))


@query("""WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS e, c_nationkey FROM customer), s AS (SELECT c_nationkey, e, min(c_custkey) AS first FROM c GROUP BY 1, 2)
 SELECT c.c_nationkey, s.first, c.c_custkey AS node_id FROM s JOIN c ON s.c_nationkey = c.c_nationkey AND s.e IS NOT DISTINCT FROM c.e""")
def null_safe_identity(spark, d):
    """All customers: the first of each one's class of nation and identity; equal firsts are the same identity."""
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("node_id"), F.expr("nullif(c_mktsegment, 'BUILDING')").alias("entity_id"))
    firsts = c.groupBy("c_nationkey", "entity_id").agg(F.min("node_id").alias("node_id"))
    return G.same_identity(firsts, c, ["c_nationkey"]).select("c_nationkey", F.col("seed").alias("first"), "node_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def answered_anti(spark, d):
    return evaluation.unanswered(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("""WITH up AS (SELECT 'c' || c_custkey AS node_id, 'n' || c_nationkey AS parent_id FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
 seed AS (SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_acctbal > 5000) SELECT node_id FROM seed UNION SELECT parent_id FROM up WHERE node_id IN (SELECT node_id FROM seed)""")
def parent_closure(spark, d):
    c = table(spark, d, "customer")
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    nodes = nodes.union(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return G.with_parents(c.where("c_acctbal > 5000").select(F.concat(F.lit("c"), "c_custkey").alias("node_id")), nodes)


@query("""SELECT regexp_replace(trim(lower(p_name)), 's+$', '') AS key, min(p_size)::DOUBLE AS t_start, max(p_retailprice) AS t_end, arg_min(trim(p_name), p_partkey) AS label, count(*) AS scenes FROM part GROUP BY 1""")
def location_rollup(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("location"), F.col("p_size").cast("double").alias("t_start"), F.col("p_retailprice").alias("t_end"), F.col("p_partkey").alias("ord"))
    return A.location_rollup(p, [])


@query(f"""WITH {NODES}, f AS (SELECT floor(t_start / 86400)::BIGINT AS day, entity_id, min(ord) AS o FROM nodes WHERE node_type = 'purchase' GROUP BY 1, 2)
 SELECT day, string_agg(entity_id, ',' ORDER BY o) AS participants FROM f GROUP BY 1""")
def episode_participants(spark, d):
    n = event_nodes(spark, d).where("node_type = 'purchase'").withColumn("day", F.floor(F.col("t_start") / 86400))
    return A.ordered_distinct(n, ["day"], "entity_id", "ord", "p").select("day", F.array_join("p", ",").alias("participants"))


@query(f"""WITH {NODES} SELECT node_type, bool_or(n >= 2) AS temporal_occurrences FROM (SELECT node_type, entity_id, count(DISTINCT floor(t_start)) AS n FROM nodes GROUP BY 1, 2) GROUP BY 1""")
def distinct_occurrences(spark, d):
    n = event_nodes(spark, d).withColumn("t_start", F.floor("t_start").cast("double"))
    return A.repeated_occurrences(n, ["node_type"])


@query("""WITH c AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second FROM c WINDOW w AS (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey))
 SELECT l_partkey, l_suppkey, score FROM r WHERE rn = 1 AND (second IS NULL OR score >= 2 * greatest(1, second))""")
def dominant_candidate(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("score"))
    return R.dominant(c, ["l_partkey"], "l_suppkey", "score").select("l_partkey", "l_suppkey", "score")


@query("""WITH v AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE event_type END AS answer, event_id FROM events), c AS (SELECT user_id, answer, count(*) AS n, min(event_id) AS f FROM v WHERE answer <> 'ERROR' GROUP BY 1, 2)
 SELECT u.user_id, coalesce(answer, 'ERROR') AS answer FROM (SELECT DISTINCT user_id FROM v) u LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) b ON u.user_id = b.user_id AND rn = 1""")
def majority_vote(spark, d):
    v = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", "ERROR").otherwise(F.col("event_type")).alias("answer"), "event_id")
    return R.majority(v, ["user_id"], "answer", "event_id")


@query(f"""WITH {NODES}, h AS (SELECT floor(t_start / 3600)::BIGINT AS hour, round(sqrt(avg(value * value)), 6) AS rms FROM nodes GROUP BY 1), s AS (SELECT avg(rms) + 2 * stddev_pop(rms) AS threshold FROM h)
 SELECT hour, rms, round(threshold, 4) AS threshold FROM h, s WHERE rms > threshold""")
def rms_peaks(spark, d):
    h = event_nodes(spark, d).groupBy(F.floor(F.col("t_start") / 3600).alias("hour")).agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))
    return A.peaks(h, [], "rms").select("hour", "rms", F.round("threshold", 4).alias("threshold"))


@query("""SELECT t AS question_type, count(*) AS total, count(*) FILTER (correct) AS correct, avg(correct::INT) AS accuracy FROM (SELECT unnest([lang, source]) AS t, quality = 1 AS correct FROM labels JOIN documents USING (doc_id)) GROUP BY 1""")
def accuracy_by_type(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return A.accuracy_by_type(r.select(F.array("lang", "source").alias("question_types"), (F.col("quality") == 1).alias("correct")))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS correct, avg((quality = 1)::INT) AS accuracy FROM labels")
def accuracy_overall(spark, d):
    return A.accuracy(table(spark, d, "labels").select((F.col("quality") == 1).alias("correct")))


@query("""SELECT o_custkey, count(*) AS total, count(a) AS answered, bool_and(a IS NOT NULL) AS complete FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS a FROM lineitem WHERE l_returnflag = 'R') ON a = o_orderkey GROUP BY 1""")
def completeness(spark, d):
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.completeness(table(spark, d, "orders").select("o_orderkey", "o_custkey"), seen, "o_custkey", "o_orderkey")


@query(f"WITH {SUCCESSORS} SELECT src, dst, relation_type FROM edges")
def spine_edges(spark, d):
    return W.spine(event_nodes(spark, d), ["user_id"], ["t_start", "ord"]).select("src", "dst", "relation_type")


@query(f"""WITH {NODES}, e AS (SELECT user_id, floor(t_start / 86400)::BIGINT AS day FROM nodes GROUP BY 1, 2) SELECT user_id, day AS src, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS dst, 'NARRATIVE_ARC' AS relation_type FROM e QUALIFY dst IS NOT NULL""")
def arc_edges(spark, d):
    e = event_nodes(spark, d).groupBy("user_id", F.floor(F.col("t_start") / 86400).alias("day")).count()
    return W.chain(e, ["user_id"], ["day"], "NARRATIVE_ARC", "day")


@query(f"""WITH {NODES}, k AS (SELECT *, lag(node_type) OVER (PARTITION BY user_id ORDER BY t_start, ord) AS prev FROM nodes WHERE node_type <> 'error') SELECT node_id, prev AS from_state, node_type AS to_state FROM k WHERE prev <> node_type""")
def state_shift(spark, d):
    n = event_nodes(spark, d).withColumn("state", F.when(F.col("node_type") == "error", "unknown").otherwise(F.col("node_type")))
    return W.state_shifts(n, ["user_id"], ["t_start", "ord"], "state").select("node_id", "from_state", "to_state")


@query(f"""WITH {NODES}, x AS (SELECT *, abs(value - lag(value) OVER w) / 300 AS hist, abs(value - lag(value, 2) OVER w) / 300 AS emb FROM nodes WINDOW w AS (PARTITION BY user_id ORDER BY t_start, ord)),
 s AS (SELECT user_id, t_start, t_end, sum(CASE WHEN hist > 0.75 OR (emb > 0.5 AND hist > 0.3) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_start, ord ROWS UNBOUNDED PRECEDING) AS segment FROM x)
 SELECT user_id, segment::BIGINT AS segment, min(t_start) AS t_start, max(t_start) AS t_last, count(*) AS frames FROM s GROUP BY 1, 2""")
def segmentation(spark, d):
    w = Window.partitionBy("user_id").orderBy("t_start", "ord")
    n = event_nodes(spark, d).withColumns({"hist": F.abs(F.col("value") - F.lag("value").over(w)) / 300, "emb": F.abs(F.col("value") - F.lag("value", 2).over(w)) / 300})
    s = W.segments(n, ["user_id"], ["t_start", "ord"], F.col("hist"), F.col("emb"))
    return s.groupBy("user_id", "segment").agg(F.min("t_start").alias("t_start"), F.max("t_start").alias("t_last"), F.count("*").alias("frames"))


@query(f"""WITH {NODES}, g AS (SELECT *, CASE WHEN t_start - lag(t_end) OVER w >= 7200 THEN 1 ELSE 0 END AS f FROM nodes WINDOW w AS (PARTITION BY user_id ORDER BY t_start, ord)),
 c AS (SELECT user_id, t_start, t_end, sum(f) OVER (PARTITION BY user_id ORDER BY t_start, ord ROWS UNBOUNDED PRECEDING) AS cluster FROM g) SELECT user_id, cluster::BIGINT AS cluster, min(t_start) AS t_start, max(t_end) AS t_end, count(*) AS n FROM c GROUP BY 1, 2""")
def gap_clusters(spark, d):
    c = W.gap_clusters(event_nodes(spark, d), ["user_id"], "t_start", "t_end", ["ord"], 7200.0)
    return c.groupBy("user_id", "cluster").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count("*").alias("n"))


def _windows_sql(last: str) -> str:
    return f"""WITH {NODES}, r AS (SELECT user_id, node_id, row_number() OVER (PARTITION BY user_id ORDER BY t_start, ord) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM nodes),
 w AS (SELECT DISTINCT user_id, n, unnest(range(0, ({last})::BIGINT + 1)) AS k FROM r) SELECT w.user_id, w.k AS window_idx, count(*) AS frames, min(i) AS first_row FROM w JOIN r ON r.user_id = w.user_id AND r.i BETWEEN w.k * 8 AND w.k * 8 + 9 GROUP BY 1, 2"""


def _count_windows(spark, d, tail):
    w = W.count_windows(event_nodes(spark, d), ["user_id"], ["t_start", "ord"], tail=tail)
    return w.groupBy("user_id", F.col("window_idx").cast("bigint").alias("window_idx")).agg(F.count("*").alias("frames"), F.min("row_idx").cast("bigint").alias("first_row"))


@query(_windows_sql("(greatest(1, n - 9) - 1) // 8"))
def count_windows_drop(spark, d):
    return _count_windows(spark, d, "drop")


@query(_windows_sql("greatest(0, ceil((n - 10) / 8.0))"))
def count_windows_keep(spark, d):
    return _count_windows(spark, d, "keep")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
 SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR i IN (0, n // 4, 2 * n // 4, 3 * n // 4)""")
def uniform_subsample(spark, d):
    return W.uniform_subsample(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query(f"""WITH {NODES}, s AS (SELECT *, least(7, floor((t_start - 86400) / 10800))::INT AS slot FROM nodes WHERE t_start >= 86400 AND t_start < 172800) SELECT user_id, slot, node_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY confidence DESC, ord) AS rn FROM s) WHERE rn = 1""")
def film_strip(spark, d):
    return W.film_strip(event_nodes(spark, d), ["user_id"], F.lit(86400.0), F.lit(172800.0), "t_start", "confidence", "ord", 8).select("user_id", "slot", "node_id")


@query(f"""WITH {NODES} SELECT user_id, bucket, node_id FROM (SELECT *, floor(t_start / 3600)::BIGINT AS bucket, row_number() OVER (PARTITION BY user_id, floor(t_start / 3600) ORDER BY ord) AS rn FROM nodes) WHERE rn = 1""")
def bucket_dedup(spark, d):
    return W.bucket_first(event_nodes(spark, d), ["user_id"], F.floor(F.col("t_start") / 3600), ["ord"]).select("user_id", "bucket", "node_id")


@query(f"""WITH RECURSIVE {NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, i) AS p FROM (SELECT floor(t_start / 86400)::BIGINT AS day, node_id, t_start AS ts, confidence AS score, row_number() OVER (PARTITION BY floor(t_start / 86400) ORDER BY t_start, ord) AS i FROM nodes)),
 b AS (SELECT day, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY 1),
 s AS (SELECT day, 0::BIGINT AS p, []::DOUBLE[] AS times, []::BIGINT[] AS idx FROM b UNION ALL SELECT s.day, r.p, CASE WHEN len(idx) < 8 AND len(list_filter(times, lambda t: abs(t - ts) < 3600)) = 0 THEN list_append(times, ts) ELSE times END, CASE WHEN len(idx) < 8 AND len(list_filter(times, lambda t: abs(t - ts) < 3600)) = 0 THEN list_append(idx, i) ELSE idx END FROM s JOIN r ON r.day = s.day AND r.p = s.p + 1),
 g AS (SELECT s.day, list_sort(list_concat([first, last], times)) AS edges, idx FROM s JOIN b ON b.day = s.day AND s.p = n
  UNION ALL SELECT day, list_sort(list_append(edges, ts)), list_append(idx, i) FROM (SELECT x.day, edges, idx, ts, i, row_number() OVER (PARTITION BY x.day ORDER BY hi - lo DESC, lo, abs(ts - (lo + hi) / 2), i) AS rn FROM (SELECT day, edges, idx, unnest(edges[:-2]) AS lo, unnest(edges[2:]) AS hi FROM g) x JOIN r ON r.day = x.day AND ts > lo AND ts < hi WHERE hi - lo > 14400) WHERE rn = 1),
 f AS (SELECT day, unnest(arg_max(idx, len(idx))) AS i FROM g GROUP BY 1) SELECT f.day, node_id, ts FROM f JOIN r USING (day, i)""")
def greedy_keyframes(spark, d):
    n = event_nodes(spark, d).withColumn("day", F.floor(F.col("t_start") / 86400)).select("day", "node_id", "ord", F.col("t_start").alias("ts"), F.col("confidence").alias("score"))
    return W.greedy_keyframes(n, ["day"], k=8, min_gap=3600.0, max_gap=14400.0).select("day", "node_id", "ts")


@query(f"""WITH {NODES}, r AS (SELECT *, node_type = 'signup' AS seed, row_number() OVER (PARTITION BY user_id ORDER BY (node_type = 'signup')::INT DESC, confidence DESC, node_id) AS rn FROM nodes) SELECT user_id, node_id FROM r WHERE seed OR rn <= 15""")
def budget_prune(spark, d):
    return R.budget_prune(event_nodes(spark, d), ["user_id"], F.col("node_type") == "signup", 15).select("user_id", "node_id")


@query(f"""WITH {SUCCESSORS}, u AS (SELECT src AS node, dst AS neighbour, confidence, eord FROM edges WHERE relation_type IN ('PRECEDES', 'OVERLAPS', 'DURING') UNION ALL SELECT dst, src, confidence, eord FROM edges WHERE relation_type IN ('PRECEDES', 'OVERLAPS', 'DURING')),
 f AS (SELECT node_id AS node FROM nodes WHERE node_type = 'purchase'), r AS (SELECT f.node, neighbour, row_number() OVER (PARTITION BY f.node ORDER BY u.confidence DESC, n.confidence DESC, eord, neighbour) AS rank FROM f JOIN u ON f.node = u.node JOIN nodes n ON n.node_id = u.neighbour)
 SELECT node, neighbour, rank, neighbour NOT IN (SELECT node FROM f) AS is_new FROM r WHERE rank <= 1""")
def expand_topk(spark, d):
    n = event_nodes(spark, d)
    return G.expand(n.where("node_type = 'purchase'"), n, event_edges(n), "temporal", 1).select("node", "neighbour", "rank", "is_new")


@query(f"""WITH RECURSIVE {SUCCESSORS}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), bfs AS (SELECT node_id, 0 AS hop FROM nodes WHERE node_type = 'error' AND value > 100 UNION SELECT b, hop + 1 FROM bfs JOIN u ON a = node_id WHERE hop < 3)
 SELECT node_id, min(hop)::INT AS hop FROM bfs GROUP BY 1""")
def causal_bfs(spark, d):
    n = event_nodes(spark, d)
    return G.reach(n.where("node_type = 'error' and value > 100"), event_edges(n), 3)


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS node, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders), e AS (SELECT * FROM o WHERE nxt IS NOT NULL),
 fw AS (SELECT o_orderkey AS root, 0 AS step, o_orderkey AS node_id FROM orders UNION ALL SELECT root, step + 1, nxt FROM fw JOIN e ON node = node_id WHERE step < 4),
 bw AS (SELECT o_orderkey AS root, 0 AS step, o_orderkey AS node_id FROM orders UNION ALL SELECT root, step - 1, node FROM bw JOIN e ON nxt = node_id WHERE step > -4)
 SELECT root, step, node_id FROM fw UNION SELECT root, step, node_id FROM bw""")
def spine_walk(spark, d):
    """From every order, four steps both ways."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("node_id"), "o_orderdate")
    e = W.chain(o, ["o_custkey"], ["o_orderdate", "node_id"], "PRECEDES").withColumn("eord", F.col("src"))
    return G.spine_walk(o, e, 4)


@query("""SELECT 'r' || n_regionkey AS root, 'n' || n_nationkey AS node_id, 1 AS level FROM nation UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'r' || n_regionkey, 'o' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def children_depth(spark, d):
    link = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"), F.lit("CONTAINS").alias("relation_type"))
    e = link("nation", "r", "n_regionkey", "n", "n_nationkey").union(link("customer", "n", "c_nationkey", "c", "c_custkey")).union(link("orders", "c", "o_custkey", "o", "o_orderkey"))
    return G.children(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id")), e, 3)


@query(f"WITH {NODES} SELECT entity_id, node_id, position FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t_start, ord) AS position FROM nodes) WHERE position <= 5")
def entity_thread(spark, d):
    return G.entity_trace(event_nodes(spark, d), first=5).select("entity_id", "node_id", "position")


@query("""SELECT l_orderkey AS src, l_partkey AS dst, o_totalprice AS src_price, p_name AS dst_label FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'""")
def causal_chains(spark, d):
    e = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_totalprice").alias("src_price"))
    return e.join(o, "src").join(table(spark, d, "part").select(F.col("p_partkey").alias("dst"), F.col("p_name").alias("dst_label")), "dst").select("src", "dst", "src_price", "dst_label")


@query(f"""WITH {SUCCESSORS}, c AS (SELECT node_id FROM nodes WHERE confidence > 0.1) SELECT src, dst, relation_type FROM edges WHERE src IN (SELECT node_id FROM c) AND dst IN (SELECT node_id FROM c)""")
def induced_subgraph(spark, d):
    n = event_nodes(spark, d)
    return G.induced(event_edges(n), n.where("confidence > 0.1")).select("src", "dst", "relation_type")


EMB = "emb AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
PAIRS = f"{EMB}, pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 6) AS score FROM emb a JOIN emb b ON a.vec_id <> b.vec_id)"


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT src, dst FROM pairs WHERE score >= 0.4), r AS (SELECT DISTINCT src AS node, src AS label FROM e UNION SELECT e.dst, r.label FROM r JOIN e ON e.src = r.node) SELECT node, min(label) AS label FROM r GROUP BY 1""")
def components(spark, d):
    p = S.similar_links(table(spark, d, "embeddings"), 0.4, "vec_id")
    return G.components(p.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("""WITH p AS (SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 3))) AS s FROM part), c AS (SELECT DISTINCT s FROM p), j AS (SELECT a.s AS sa, b.s AS sb, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS u FROM c a, c b)
 SELECT p_partkey, array_to_string(sa, ' ') AS class, array_to_string(sb, ' ') AS like_class, round(i / u, 6) AS score FROM p JOIN j ON s = sa WHERE u > 0 AND i / u >= 0.4""")
def token_jaccard(spark, d):
    """All parts: the class of equal words of each, and the classes like it (its own too), in place of all pairs."""
    p = table(spark, d, "part").select("p_partkey", F.array_sort(T.words("p_name")).alias("sa"))
    c = p.select("sa").distinct()
    a, b = c.select("sa", F.explode("sa").alias("w")), c.select(F.col("sa").alias("sb"), F.explode("sa").alias("w"))
    j = a.join(b, "w").select("sa", "sb").distinct().withColumn("score", F.round(T.jaccard(F.col("sa"), F.col("sb")), 6)).where("score >= 0.4")
    return p.join(j, "sa").select("p_partkey", F.array_join("sa", " ").alias("class"), F.array_join("sb", " ").alias("like_class"), "score")


@query("""WITH s AS (SELECT conv_id || '_' || turn AS src, turn * 30.0 AS t, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 3))) AS w FROM conversations),
 e AS (SELECT item_id AS dst, (item_id % 8) * 30.0 AS t, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: length(x) > 3))) AS w FROM benchmark) SELECT DISTINCT src, dst FROM s JOIN e ON s.w = e.w AND abs(s.t - e.t) <= 60""")
def mentions_join(spark, d):
    s = table(spark, d, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("node_id"), (F.col("turn") * 30.0).alias("t_start"), F.col("text").alias("label"))
    e = table(spark, d, "benchmark").select(F.col("item_id").alias("node_id"), ((F.col("item_id") % 8) * 30.0).alias("t_start"), F.col("text").alias("label"))
    return M.mentions(s, e, gap=60.0)


@query("""WITH k AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{4,}')) AS w FROM documents) SELECT doc_id, len(w) AS keywords, len(list_filter(['that', 'with', 'thing'], lambda x: contains(lower(text), x))) AS hits FROM k JOIN documents USING (doc_id)""")
def keyword_rank(spark, d):
    wanted = F.array(F.lit("that"), F.lit("with"), F.lit("thing"))
    return table(spark, d, "documents").select("doc_id", F.size(T.keywords("text", [""])).cast("bigint").alias("keywords"), T.keyword_hits(wanted, "text").cast("bigint").alias("hits"))


@query(f"""WITH {EMB}, q AS (SELECT v AS qv FROM emb WHERE vec_id = 7), s AS (SELECT vec_id, round(list_dot_product(v, qv) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(qv, qv)), 6) AS score FROM emb, q) SELECT * FROM (SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20) WHERE score >= 0.25""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 7").first()["embedding"]  # one query vector
    return S.vector_topk(e, q, 20, 0.25, "vec_id")


@query(f"""WITH {EMB}, m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(0, 64)) AS i FROM emb) GROUP BY 1, 2), p AS (SELECT label, list(m ORDER BY i) AS pv FROM m GROUP BY 1)
 SELECT vec_id, label, score FROM (SELECT vec_id, p.label, round(list_dot_product(v, pv) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(pv, pv)), 6) AS score FROM emb, p) WHERE score >= 0.25""")
def zero_shot_label(spark, d):
    e = table(spark, d, "embeddings")
    return S.zero_shot(e.drop("label"), S.prototypes(e, "label"), "label", 0.25, "vec_id")


@query(f"""WITH {PAIRS} SELECT src, dst, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM pairs WHERE score >= 0.3) WHERE rank <= 10""")
def knn_edges(spark, d):
    return S.knn_edges(table(spark, d, "embeddings"), 10, 0.3, "vec_id").select("src", "dst", "score", "rank")


@query(f"""WITH {EMB}, q AS (SELECT v AS qv FROM emb WHERE vec_id = 7), vh AS (SELECT vec_id AS doc_id, score FROM (SELECT vec_id, round(list_dot_product(v, qv) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(qv, qv)), 6) AS score FROM emb, q ORDER BY score DESC, vec_id LIMIT 50) WHERE score >= 0.25),
 kh AS (SELECT doc_id, 0.5 + 0.4 * len(list_filter(['idiot', 'license'], lambda x: contains(lower(text), x))) / 2 AS score FROM documents WHERE len(list_filter(['idiot', 'license'], lambda x: contains(lower(text), x))) > 0),
 b AS (SELECT doc_id, max(score) AS score FROM (SELECT * FROM vh UNION ALL SELECT * FROM kh) GROUP BY 1) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 30""")
def hybrid_search(spark, d):
    e = table(spark, d, "embeddings")
    docs = table(spark, d, "documents")
    q = e.where("vec_id = 7").first()["embedding"]
    vh = S.vector_topk(e, q, 50, 0.25, "vec_id").withColumnRenamed("vec_id", "doc_id")
    kh = docs.select("doc_id", T.keyword_score(F.array(F.lit("idiot"), F.lit("license")), "text").alias("score")).where("score is not null")
    return S.hybrid(vh, kh, docs.select("doc_id", "lang"), 30, F.col("lang") == "en", id_col="doc_id").select("doc_id", "score", "rank")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>|\\{[^}]*\\}', '', 'g'), '\\s+', ' ', 'g')) AS text FROM pages""")
def caption_clean(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_caption("html").alias("text"))


_REFS = [("03:56-05:00", 236.0, 300.0), ("40:20-40:20", 2420.0, 2420.0), ("88:07-88:07", 5287.0, 5287.0), ("00:00-100:54", 0.0, 6054.0), ("85:50-85:35", 5135.0, 5150.0), ("", None, None), ("   ", None, None), ("not-a-time", None, None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else b}::DOUBLE, {'NULL' if c is None else c}::DOUBLE)" for a, b, c in _REFS) + ") t(ref, t0, t1)")
def time_ref_parse(spark, d):
    return spark.createDataFrame([(a,) for a, _, _ in _REFS], "ref string").withColumn("r", T.time_range("ref")).select("ref", "r.t0", "r.t1")


@query("""SELECT * FROM (VALUES (1, 'red car', 'the blue car', 'van', 'B'), (2, 'yes', 'no', NULL, 'A'), (3, NULL, NULL, NULL, '')) t(id, a, b, c, answer)""")
def mcq_parse(spark, d):
    rows = [(1, "Which? (A) red car (B) the  blue car (C) van", "<think>C</think>I pick\nB\n"), (2, "Is it? (A) yes (B) no", "It is (B)? No: A"), (3, "No options", "none")]
    o = spark.createDataFrame(rows, "id int, question string, said string").withColumn("o", T.options("question"))
    get = lambda k: F.try_element_at("o", F.lit(k))
    return o.select("id", get("A").alias("a"), get("B").alias("b"), get("C").alias("c"), T.answer_letter("said").alias("answer"))


@query("""WITH b AS (SELECT p_partkey, (p_partkey % 7)::DOUBLE AS x0, (p_partkey % 5)::DOUBLE AS y0, (p_partkey % 7 + p_size)::DOUBLE AS x1, (p_partkey % 5 + p_size)::DOUBLE AS y1 FROM part),
 i AS (SELECT *, greatest(least(x1, 10) - greatest(x0, 2), 0) * greatest(least(y1, 10) - greatest(y0, 2), 0) AS inner_area FROM b) SELECT p_partkey, round(CASE WHEN inner_area > 0 THEN inner_area / ((x1 - x0) * (y1 - y0) + 64 - inner_area) ELSE 0 END, 9) AS iou FROM i""")
def box_iou(spark, d):
    p = table(spark, d, "part")
    c = lambda m: (F.col("p_partkey") % m).cast("double")
    a = F.array(c(7), c(5), c(7) + F.col("p_size"), c(5) + F.col("p_size"))
    return p.select("p_partkey", F.round(V.box_iou(a, F.array(*[F.lit(x) for x in (2.0, 2.0, 10.0, 10.0)])), 9).alias("iou"))


_ASKED = [("Where is the knife on the table?", None, "SPATIAL"), ("Who is the person in the red jacket?", None, "IDENTITY"), ("Summarize what happened in the video.", None, "SUMMARY"), ("What if he had not opened the door?", None, "COUNTERFACT"),
          ("blah blah blah nothing", None, "SEMANTIC"), ("anything", "['Temporal Grounding', 'reasoning']", "TEMPORAL,CAUSAL,INTENTIONAL")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{i}')" for q, _, i in _ASKED) + ") t(question, intents)")
def intent_route(spark, d):
    q = spark.createDataFrame([(a, b) for a, b, _ in _ASKED], "question string, question_type string")
    return activation.classify_intent(q).select("question", F.array_join("intents", ",").alias("intents"))


@query(f"""WITH {SUCCESSORS}, seed AS (SELECT node_id FROM nodes WHERE t_start <= 100830 AND t_end >= 86370), u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
 one AS (SELECT node_id FROM seed UNION SELECT b FROM u JOIN seed ON a = node_id), r AS (SELECT n.*, n.node_id IN (SELECT node_id FROM seed) AS is_seed, row_number() OVER (ORDER BY (n.node_id IN (SELECT node_id FROM seed))::INT DESC, confidence DESC, n.node_id) AS rn FROM nodes n WHERE n.node_id IN (SELECT node_id FROM one))
 SELECT node_id, is_seed FROM r WHERE is_seed OR rn <= 60""")
def activate_time(spark, d):
    n = event_nodes(spark, d)
    return activation.activate_window(n, event_edges(n), 86400.0, 100800.0, hops=1).select("node_id", "is_seed")


@query(f"""WITH {NODES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_start, ord) AS i FROM nodes WHERE t_start BETWEEN 86370 AND 172830)
 SELECT user_id, string_agg(printf('[%d-%d] %s: %s', floor(t_start)::BIGINT, floor(t_end)::BIGINT, node_type, label), chr(10) ORDER BY i) AS context FROM n GROUP BY 1""")
def serialize_context(spark, d):
    n = event_nodes(spark, d).where(F.col("t_start").between(86370, 172830))
    return serialization.timeline(n, ["user_id"], "t_start", "ord").select("user_id", "context")


@query(f"""WITH {SUCCESSORS}, q AS (SELECT user_id, bool_or(node_type = 'error') AS causal, bool_or(node_type = 'purchase') AS entity FROM nodes GROUP BY 1),
 t AS (SELECT user_id, bool_or(c >= 2) AS temporal FROM (SELECT user_id, node_type, count(DISTINCT floor(t_start)) AS c FROM nodes GROUP BY 1, 2) GROUP BY 1) SELECT user_id, round((causal::INT + temporal::INT + entity::INT) / 3, 6) AS coverage, causal AND temporal AND entity AS complete FROM q JOIN t USING (user_id)""")
def coverage_score(spark, d):
    n = event_nodes(spark, d).withColumn("t_start", F.floor("t_start").cast("double")).withColumn("entity_id", F.col("node_type"))
    facts = n.groupBy("user_id").agg(F.bool_or(F.col("node_type") == "error").alias("causal_edge"), F.bool_or(F.col("node_type") == "purchase").alias("entity_or_frame"))
    facts = facts.join(A.repeated_occurrences(n, ["user_id"]), "user_id")
    slots = facts.withColumn("slots", F.array(*map(F.lit, ("causal_edge", "temporal_occurrences", "entity_or_frame"))))
    c = warrant.coverage(slots, ["user_id"])
    return c.select("user_id", F.round("coverage", 6).alias("coverage"), F.size("gaps").alias("g")).select("user_id", "coverage", (F.col("g") == 0).alias("complete"))


@query(f"""WITH {NODES}, c AS (SELECT user_id, 'ev_' || (user_id * 3) AS cited FROM events GROUP BY 1) SELECT c.user_id, EXISTS (SELECT 1 FROM nodes n WHERE n.user_id = c.user_id AND n.node_id = c.cited) AS ok FROM c""")
def citation_check(spark, d):
    n = event_nodes(spark, d)
    cited = n.select("user_id").distinct().withColumn("cited", F.array(F.concat(F.lit("ev_"), F.col("user_id") * 3)))
    return warrant.citations_inside(cited, n, ["user_id"])


@query("SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS eord FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def edge_dedup(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("CONTAINS").alias("relation_type"), F.col("l_linenumber").alias("eord"))
    return G.deduplicated(e).select("src", "dst", "eord")


@query("SELECT (props->>'$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1")
def props_json(spark, d):
    return table(spark, d, "events").select(F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, k AS (SELECT entity_id, node_id, ord FROM nodes WHERE node_type = 'signup') SELECT a.node_id AS src, b.node_id AS dst FROM k a JOIN k b ON a.entity_id = b.entity_id AND a.ord < b.ord""")
def same_entity(spark, d):
    return G.same_entity(event_nodes(spark, d).where("node_type = 'signup'")).select("src", "dst")


@query("SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, round(sqrt(avg(value * value)), 9) AS rms, count(*) AS n FROM events GROUP BY 1")
def stream_windows(spark, d):
    from .streaming import events as stream

    return stream.run_once(spark, d).select(F.unix_seconds("start").alias("start"), F.round("rms", 9).alias("rms"), "n")
