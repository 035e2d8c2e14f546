"""Quality rules: rule statistics of whole texts, and isolation forests over them.

A forest isolates a document by random splits of its statistics; a short path marks an anomaly.  One forest
sees the symbols of a text, one its repeated and distinct words, one its duplicate lines and word length;
a document that one of them rejects is rejected.  The forests learn from all labelled rows that pass the base
rules: each tree draws its ``TREE_ROWS`` from all of them, as isolation trees do, and every one of them takes
part in the calibration.  The scores above which a document is rejected are set one after the other on the
rows that the forests before keep: of all thresholds with which at least ``keep`` of all good rows stay, the
one with most bad rows rejected less four times the good ones.

Defined cases: a null or empty text has no words and fails the base rules; texts of any length count
whole; with fewer than ``LEAST_GOOD`` good labelled rows that pass the base rules there is no forest, and
documents are judged by the base rules alone; an id that is repeated is learned from once and its rows are
judged each; a score at the threshold is kept; other columns are kept by ``filter_documents`` and ignored
otherwise; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, held, id_column, materialize, slices

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
#: Rows of a tree are drawn from all labelled rows anew.
TREES, TREE_ROWS, SEED = 100, 256, 7
#: Good labelled rows below which no forest is grown.
LEAST_GOOD = 32
#: Parts of the labelled rows by a hash of their ids, and of the scores from 0 to 1, in which rows are ordered.
PARTS, BINS = 1024, 4096
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What each forest sees; in one forest the others would blur what a few of them show.
FAMILIES = (
    ("symbols_per_word", "mark_share", "bare_share", "symbol_word_share"),
    ("repeat_share", "distinct_share", "top_word_share", "twin_share"),
    ("dup_line_share", "mean_word"),
)
FEATURES = tuple(name for family in FAMILIES for name in family)
#: Words of a stretch in which distinct words are counted, so that their share does not fall with a text's length.
STRETCH = 32
_BLANK, _MARK, _SYMBOL, _PLAIN = (np.array([chr(c) in s for c in range(256)]) for s in (" \t\n\v\f\r", "!?", SYMBOLS, ""))
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def repeated_words(words: np.ndarray) -> int:
    """Words, given by their numbers, inside windows of eight words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = words
    # windows of 1, 2, 4 and 8 words get dense numbers: equal numbers are equal windows
    for step in (1, 2, 4):
        pair = ids[:-step] * np.int64(len(words) + 1) + ids[step:]
        _, ids = np.unique(pair, return_inverse=True)
    seen = np.bincount(ids)[ids] > 1
    if not seen.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(seen)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base statistics, and the features that the forests see."""
    raw = text.encode()
    words = raw.split()  # at the same six white-space bytes
    n = len(words)
    blanks = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    word_chars = len(text) - blanks
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    dup_lines = len(lines) - len(set(lines))
    ids = numbered(words)
    repeat = repeated_words(ids)
    if not n:
        return (0, 0, symbols, dup_lines, 0), (0.0,) * len(FEATURES)
    codes = np.frombuffer(raw, np.uint8)
    blank = _BLANK[codes]
    first = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    with_symbol = np.add.reduceat(_SYMBOL[codes], first, dtype=np.int64) > 0
    bare = int((with_symbol & (np.add.reduceat(_PLAIN[codes], first, dtype=np.int64) == 0)).sum())
    marked = int(with_symbol.sum())
    distinct = len(np.unique(np.arange(n) // STRETCH * n + ids))
    twins = int((ids[1:] == ids[:-1]).sum())
    features = (
        symbols / n, int(_MARK[codes].sum()) / n, bare / n, marked / n,
        repeat / n, distinct / n, int(np.bincount(ids).max()) / n, twins / n,
        dup_lines / max(len(lines), 1), word_chars / n,
    )
    return (n, word_chars, symbols, dup_lines, repeat), features


@dataclass
class Forest:
    """Random split trees as flat arrays; ``path`` is what a leaf counts as, with its rows' mean depth."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    scale: float
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t][node]
                inner = f >= 0
                if not inner.any():
                    break
                step = self.left[t][node] + (x[rows, np.maximum(f, 0)] >= self.split[t][node])
                node = np.where(inner, step, node)
            total += self.path[t][node]
        return 2.0 ** (-total / len(self.feature) / self.scale)


@dataclass
class Forests:
    """The calibrated forest of each family of features, with the family's columns."""

    parts: list[tuple[slice, Forest]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The largest score over its threshold; above one is rejected."""
        return np.max([f.scores(x[:, c]) / f.threshold for c, f in self.parts], axis=0)


def _mean_depth(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, drawn: np.ndarray, seed: int = SEED) -> Forest:
    """One tree for each row of ``drawn``, which holds the places of the tree's rows in ``x``."""
    rng = np.random.default_rng(seed)
    size = drawn.shape[1]
    limit = int(np.ceil(np.log2(max(size, 2)))) + 2
    trees = []
    for start in drawn:
        feature, split, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, start, 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(wide):
                path[node] = depth + _mean_depth(len(rows))
                continue
            f = int(rng.choice(wide))
            at = float(rng.uniform(low[f], high[f]))
            at = at if at > low[f] else float(high[f])
            feature[node], split[node], left[node] = f, at, len(feature)
            goes = x[rows, f] >= at
            for part in (rows[~goes], rows[goes]):
                todo.append((len(feature), part, depth + 1))
                feature.append(-1), split.append(0.0), left.append(0), path.append(0.0)
        trees.append((feature, split, left, path))
    most = max(len(t[0]) for t in trees)
    flat = [np.array([row + [fill] * (most - len(row)) for row in column]) for column, fill in zip(zip(*trees), (-1, 0.0, 0, 0.0))]
    return Forest(*flat, scale=max(_mean_depth(size), 1e-9), threshold=np.inf)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics of every row, whether it fails the base rules, and the features that the forests see."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality rules")
        for batch, texts in slices(batches, text_col):
            stats = [statistics(t) for t in texts]
            columns = [pa.array([b[i] for b, _ in stats], pa.int64()) for i in range(len(BASE))]
            failed, features = pa.array([base_failed(b) for b, _ in stats]), pa.array([list(f) for _, f in stats], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([id_column(batch, id_col), *columns, failed, features], ["id", *BASE, "base_failed", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, features array<double>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(id_column(batch, "features").flatten(), float).reshape(batch.num_rows, len(FEATURES))


def draw(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the rows that the trees see, and for each tree the places of its rows among them.

    All ``rows`` are numbered, part by part in the order of a hash of their ids, and numbers are drawn; at most
    ``TREES * TREE_ROWS`` rows reach the driver.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "features", F.xxhash64("id").alias("hash")).withColumn("part", F.pmod("hash", F.lit(PARTS)))
    parts = sorted(rows.groupBy("part").count().collect())
    ends = np.cumsum([r["count"] for r in parts])
    rng = np.random.default_rng(SEED)
    size = min(TREE_ROWS, int(ends[-1]))
    numbers, drawn = np.unique([rng.choice(int(ends[-1]), size, replace=False) for _ in range(TREES)], return_inverse=True)
    own = np.searchsorted(ends, numbers, side="right")
    chosen = [(parts[k]["part"], int(n - ends[k] + parts[k]["count"]) + 1, place) for place, (n, k) in enumerate(zip(numbers, own))]
    chosen = spark.createDataFrame(chosen, "part bigint, nth int, place int").coalesce(1)
    nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("hash", "id")))
    got = nth.join(F.broadcast(chosen), ["part", "nth"]).select("place", "features").toPandas().sort_values("place")
    return np.array(got["features"].tolist()), drawn.reshape(TREES, size)


def calibrate(scored: DataFrame, most: int) -> float:
    """The threshold for rows of ``score`` and ``good``, of which the good ones up to number ``most`` stay.

    All rows count.  Equal scores are one row; they are ordered in bins, and the driver gets sums of bins.
    """
    good = F.col("good").cast("long")
    counts = scored.groupBy("score").agg(F.sum(good).alias("right"), F.sum(1 - good).alias("wrong")).withColumn("bin", F.floor(F.col("score") * BINS))
    last = F.max(F.when(F.col("right") > 0, F.col("score"))).alias("last")
    bins = sorted(counts.groupBy("bin").agg(F.sum("right").alias("right"), F.sum("wrong").alias("wrong"), last).collect())
    right, wrong = np.cumsum([b["right"] for b in bins]), np.cumsum([b["wrong"] for b in bins])
    end = max(b["last"] for b in bins if b["right"]) + 1e-6
    # the lowest threshold: the good row after the ones that must stay
    rank = min(int(right[-1]) - 1, most) + 1
    k = int(np.searchsorted(right, rank))
    upward = Window.partitionBy("bin").orderBy("score")
    inside = counts.where(F.col("bin") == bins[k]["bin"]).withColumn("upto", F.sum("right").over(upward))
    floor = inside.where(F.col("upto") >= rank - int(right[k]) + bins[k]["right"]).agg(F.min("score")).first()[0]
    # rows above each score: those of higher bins, and those of its own
    higher = [(b["bin"], int(right[-1] - right[i]), int(wrong[-1] - wrong[i])) for i, b in enumerate(bins)]
    higher = scored.sparkSession.createDataFrame(higher, "bin bigint, more_right bigint, more_wrong bigint").coalesce(1)
    above = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    over = {c: F.coalesce(F.sum(c).over(above), F.lit(0)) + F.col(f"more_{c}") for c in ("right", "wrong")}
    options = counts.where(F.col("score") >= floor).join(F.broadcast(higher), "bin").withColumn("gain", over["wrong"] - 4 * over["right"])
    option = F.when((F.col("score") == floor) | (F.col("wrong") > 0), F.struct("gain", (-F.col("score")).alias("least")))
    best, beyond = options.agg(F.max(option), F.sum(F.when(F.col("score") > end, F.col("wrong")).otherwise(0))).first()
    return -max(tuple(best), (beyond, -end))[1]


def fit_measured(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = 0.985) -> Forests | None:
    """Grow and calibrate the forests on all labelled rows of a table that ``measure`` gave.

    Bad rows are among those that the trees see, so splits fall between them and the others.
    """
    graded = labels.select(F.col(id_col).alias("id"), "quality").where("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("quality"))
    # one row for each id, however often it is repeated
    found = measured.join(graded, "id").groupBy("id").agg(F.min(F.struct("features", "quality", "base_failed")).alias("x"))
    rows = materialize(found.where("not x.base_failed").select("id", "x.features", (F.col("x.quality") >= 1).alias("good")), "labelled")
    n_good = rows.where("good").count()
    if n_good < LEAST_GOOD:
        forget(rows)
        return None
    x, drawn = draw(rows)
    parts, start = [], 0
    for family in FAMILIES:
        columns = slice(start, start := start + len(family))
        parts.append((columns, grow(x[:, columns], drawn)))
    shared = measured.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            scores = [pa.array(forest.scores(x[:, columns])) for columns, forest in shared.value]
            yield pa.RecordBatch.from_arrays([id_column(batch, "good"), *scores], ["good", *names])

    names = [f"score{k}" for k in range(len(FAMILIES))]
    scored = materialize(rows.select("good", "features").mapInArrow(run, "good boolean, " + ", ".join(f"{c} double" for c in names)), "scores")
    stays, most = scored, int(np.ceil(keep * n_good))
    for name, (_, forest) in zip(names, parts):
        forest.threshold = calibrate(stays.select("good", F.col(name).alias("score")), most)
        stays = stays.where(F.col(name) <= forest.threshold)
    forget(rows, scored)
    return Forests(parts)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.985) -> Forests | None:
    """Grow and calibrate the forests on all labelled rows; every text is measured once."""
    measured = materialize(measure(docs, id_col, text_col), "rules")
    forests = fit_measured(measured, labels, id_col, keep)
    forget(measured)
    return forests


def base_failed(base: tuple[int, ...]) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT * base[0]


def judge_measured(measured: DataFrame, forest: Forests | None, id_col: str = "doc_id") -> DataFrame:
    """Anomaly scores and verdicts of a table that ``measure`` gave, with its statistics."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)  # a forest a family, TREES trees of 2 * TREE_ROWS nodes each

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            failed = np.asarray(id_column(batch, "base_failed"), bool)
            score = f.scores(_matrix(batch)) if f else np.zeros(batch.num_rows)
            kept = ~failed & (score <= 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept), pa.array(score)], ["id", *BASE, "base_failed", "kept", "anomaly"])

    kind = measured.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double"
    return measured.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def judge(docs: DataFrame, forest: Forests | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every row, whether it fails the base rules, its anomaly score, and the verdict."""
    return judge_measured(measure(docs, id_col, text_col), forest, id_col)


def filter_documents(docs: DataFrame, forest: Forests | None, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality rules")
        f = shared.value
        for batch, texts in slices(batches, text_col):
            stats = [statistics(t) for t in texts]
            score = f.scores(np.array([x for _, x in stats])) if f else np.zeros(len(texts))
            kept = ~np.array([base_failed(b) for b, _ in stats]) & (score <= 1)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
