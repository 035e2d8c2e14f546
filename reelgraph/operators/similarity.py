"""Vector search, classification by prototypes, similarity edges and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import normalized, similarity
from ..shared import shared_dir
from .ranking import top_per_group

#: Vectors of one block of a blocked join, about, while blocks are few, and when they are many: each vector is sent
#: once for each block, so their number decides what is shuffled; a task holds two blocks, and the product of
#: ``BLOCK_ROWS`` rows of one with the other.
BLOCK_ROWS, MOST_ROWS, FEW_BLOCKS = 1024, 8192, 8
#: What rounding to six digits may move.
SLACK = 2e-6


def vector_topk(vectors: DataFrame, query: list[float], k: int, least: float, id_col: str = "node_id", vector_col: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The ``k`` best rows for one query vector, then those at or above ``least``; places to six digits."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", F.round(similarity(vector_col, q, metric), 6)).select(id_col, "score")
    return scored.orderBy(F.desc("score"), id_col).limit(k).where(F.col("score") >= least)


def prototypes(vectors: DataFrame, label: str, vector_col: str = "embedding") -> DataFrame:
    """Unit mean vector of each label."""
    at = vectors.select(label, F.posexplode(vector_col).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return at.groupBy(label).agg(packed.alias("rg_v")).select(label, normalized("rg_v").alias("prototype"))


def zero_shot(vectors: DataFrame, labels: DataFrame, label: str, least: float = 0.25, id_col: str = "node_id", vector_col: str = "embedding") -> DataFrame:
    """Labels of each row whose prototype is similar enough: blocks of rows times blocks of prototypes.

    The vocabulary of labels may be of any size; each row is sent once for each block of it.
    """
    v = vectors.select(F.col(id_col).alias("rg_id"), normalized(vector_col).alias("rg_v")).where("rg_v is not null").withColumn("rg_n", F.size("rg_v"))
    p = labels.select(F.col(label).alias("rg_id"), normalized("prototype").alias("rg_v")).where("rg_v is not null").withColumn("rg_n", F.size("rg_v"))
    shared_dir(vectors.sparkSession)
    p = p.checkpoint()  # prototypes are means over a table; they are read several times
    deal = lambda rows, n: rows.join(rows.groupBy("rg_n").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias(n)), "rg_n")
    block = lambda n: F.pmod(F.xxhash64("rg_id", "rg_v"), F.col(n)).cast("int")
    p = deal(p, "rg_p").withColumn("bj", block("rg_p"))
    sizes = p.select("rg_n", "rg_p").distinct()
    v = deal(v, "rg_b").join(sizes, "rg_n").withColumn("bi", block("rg_b")).withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("rg_p") - 1)))
    p = p.join(v.select("rg_n", "rg_b").distinct(), "rg_n").withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("rg_b") - 1)))
    key = ["rg_n", "bi", "bj"]
    kinds = [t.schema["rg_id"].dataType.simpleString() for t in (v, p)]
    right = p.select(*[F.col(c).alias(c) for c in (*key, "rg_id", "rg_v")])
    pairs = v.select(*key, "rg_id", "rg_v").groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda of, left, found: _product(of, left, found, 0, least, None, False), f"src {kinds[0]}, dst {kinds[1]}, score double")
    return pairs.withColumn("score", F.round("score", 6)).where(F.col("score") >= least).select(F.col("src").alias(id_col), F.col("dst").alias(label), "score")


def _product(of: tuple, left: pa.Table, right: pa.Table, on: int, least: float, best: int | None, mirrored: bool) -> pa.Table:
    """Pairs of two blocks at least so similar, as a matrix product; both ways where the blocks are of one table."""
    found: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
    if left.num_rows and right.num_rows:
        ids, rows = _rows(left, right)
        sides = [(0, 1)] if not mirrored or of[-2] == of[-1] else [(0, 1), (1, 0)]  # a block meets itself once
        for own, other in sides:
            for at in range(0, len(rows[own]), BLOCK_ROWS):
                s = rows[own][at : at + BLOCK_ROWS] @ rows[other].T
                hit = s >= least - SLACK
                if best is not None and s.shape[1] > best + 1:  # one may be the row itself
                    hit &= s >= np.partition(s, s.shape[1] - best - 1, axis=1)[:, s.shape[1] - best - 1, None] - SLACK
                i, j = np.nonzero(hit)
                found.append((ids[own].take(pa.array(i + at)), ids[other].take(pa.array(j)), s[i, j]))
    kinds = [t.schema.field("rg_id").type for t in (left, right)]
    parts = [pa.concat_arrays([f[c] for f in found]) if found else pa.array([], kinds[c]) for c in (0, 1)]
    scores = np.concatenate([f[2] for f in found]) if found else np.zeros(0)
    same = [pa.array([x.as_py()] * len(scores), x.type) for x in of[:on]]
    return pa.table([*same, *parts, pa.array(scores)], [*[f"on{i}" for i in range(on)], "src", "dst", "score"])


def _rows(left: pa.Table, right: pa.Table) -> tuple:
    return tuple(zip(*((t.column("rg_id").combine_chunks(), np.asarray(t.column("rg_v").combine_chunks().flatten()).reshape(t.num_rows, -1)) for t in (left, right))))


def _tie(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of rows i and j; a label is the first row of a component."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _links(of: tuple, left: pa.Table, right: pa.Table, on: int, least: float) -> pa.Table:
    """Ties of two blocks' rows to the first row of each component that their similar pairs make."""
    src, dst = left.column("rg_id").slice(0, 0).combine_chunks(), left.column("rg_id").slice(0, 0).combine_chunks()
    if left.num_rows and right.num_rows:
        ids, rows = _rows(left, right)
        other = 0 if of[-2] == of[-1] else len(rows[0])  # where the right rows are numbered from
        label = np.arange(other + len(rows[1]))
        for at in range(0, len(rows[0]), BLOCK_ROWS):
            s = rows[0][at : at + BLOCK_ROWS] @ rows[1].T
            hit = s >= least - SLACK
            for i, j in zip(*np.nonzero(hit & (s < least + SLACK))):  # as Spark rounds
                hit[i, j] = float(Decimal(repr(float(s[i, j]))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) >= least
            i, j = np.nonzero(hit)
            _tie(label, i + at, j + other)
        every = ids[0] if not other else pa.concat_arrays(ids)
        tied = np.flatnonzero(label != np.arange(len(label)))
        src, dst = every.take(pa.array(tied)), every.take(pa.array(label[tied]))
    same = [pa.array([x.as_py()] * len(src), x.type) for x in of[:on]]
    return pa.table([*same, src, dst], [*[f"on{i}" for i in range(on)], "src", "dst"])


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, on: Sequence[str]) -> tuple[DataFrame, DataFrame, dict]:
    """Both sides of the blocked self join, and the types of their columns."""
    v = vectors.select(*on, F.col(id_col).alias("rg_id"), normalized(vector_col).alias("rg_v")).where("rg_v is not null").withColumn("rg_n", F.size("rg_v"))
    key = [*on, "rg_n"]
    of = lambda n: F.ceil(F.count("*") / F.lit(n))
    sizes = v.groupBy(*key).agg(F.greatest(of(MOST_ROWS), F.least(of(BLOCK_ROWS), F.lit(FEW_BLOCKS))).cast("int").alias("rg_blocks"))
    v = v.join(sizes, key).withColumn("rg_b", F.pmod(F.xxhash64("rg_id", "rg_v"), F.col("rg_blocks")).cast("int"))
    a = v.select(*key, "rg_id", "rg_v", F.col("rg_b").alias("bi"), F.explode(F.sequence("rg_b", F.col("rg_blocks") - 1)).alias("bj"))
    b = v.select(*[F.col(c).alias(c) for c in (*key, "rg_id", "rg_v")], F.explode(F.sequence(F.lit(0), "rg_b")).alias("bi"), F.col("rg_b").alias("bj"))
    return a, b, {f.name: f.dataType.simpleString() for f in v.schema}


def similar_links(vectors: DataFrame, least: float, id_col: str = "node_id", vector_col: str = "embedding", on: Sequence[str] = ()) -> DataFrame:
    """Links (src, dst) that make the same components as ``similar_pairs``, and of the same rows: each pair of blocks
    passes on fewer links than it has rows, not all its pairs."""
    a, b, kinds = _blocks(vectors, id_col, vector_col, on)
    key, n_on, names = [*on, "rg_n", "bi", "bj"], len(on), [*on, "src", "dst"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in on), f"src {kinds['rg_id']}", f"dst {kinds['rg_id']}"])
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(lambda of, left, right: _links(of, left, right, n_on, least).rename_columns(names), schema).where("src <> dst")


def similar_pairs(vectors: DataFrame, least: float, id_col: str = "node_id", vector_col: str = "embedding", on: Sequence[str] = (), best: int | None = None) -> DataFrame:
    """All ordered pairs of different rows at least so similar, by a blocked self join inside each group.

    Rows are dealt by a hash to as many blocks as their group's size asks for; each pair of blocks is one
    matrix product, so no task holds a group.  With ``best``, a block only passes on what may still be
    among so many of a row.  Vectors of different lengths do not meet; null vectors take no part.
    """
    a, b, kinds = _blocks(vectors, id_col, vector_col, on)
    key = [*on, "rg_n"]
    n_on, names = len(on), [*on, "src", "dst", "score"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in on), f"src {kinds['rg_id']}", f"dst {kinds['rg_id']}", "score double"])
    pairs = a.groupBy(*key, "bi", "bj").cogroup(b.groupBy(*key, "bi", "bj")).applyInArrow(lambda of, left, right: _product(of, left, right, n_on, least, best, True).rename_columns(names), schema)
    return pairs.where("src <> dst").withColumn("score", F.round("score", 6)).where(F.col("score") >= least)


def knn_edges(vectors: DataFrame, k: int = 10, least: float = 0.78, id_col: str = "node_id", vector_col: str = "embedding", on: Sequence[str] = (), parents: DataFrame | None = None) -> DataFrame:
    """Directed edges to the ``k`` nearest rows at or above a similarity, without parents and children."""
    pairs = similar_pairs(vectors, least, id_col, vector_col, on, best=k)
    best = top_per_group(pairs, [*on, "src"], k, F.desc("score"), F.col("dst"), rank="rank")
    if parents is not None:  # columns node_id, parent_id
        for a, b in (("src", "dst"), ("dst", "src")):
            best = best.join(parents.select(*on, F.col("node_id").alias(a), F.col("parent_id").alias(b)), [*on, a, b], "left_anti")
    return best.withColumn("relation_type", F.lit("SIMILAR_TO"))


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, nodes: DataFrame, most: int = 30, keep=None, on: Sequence[str] = (), id_col: str = "node_id") -> DataFrame:
    """The better score of each node from either list, filtered afterwards, cut, and in order of time."""
    both = vector_hits.select(*on, id_col, "score").union(keyword_hits.select(*on, id_col, "score")).groupBy(*on, id_col).agg(F.max("score").alias("score"))
    joined = both.join(nodes, [*on, id_col])
    joined = joined if keep is None else joined.where(keep)
    best = top_per_group(joined, on, most, F.desc("score"), F.col(id_col), rank="rank") if on else joined.orderBy(F.desc("score"), id_col).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))
    return best
