"""Quality classifier: ordinal regression with cumulative links over hashed text.

A row's grade is how many of two ratings are good, quality and freedom from toxicity: 0, 1 or 2, so that
defects add up.  All grades share one weight per hashed feature; ordered thresholds cut the score into grades:
P(grade <= k) = 1 / (1 + exp(score - threshold_k)).  A document gets its expected grade, and the tail
probability of the highest grade by which it is selected.

Features are the distinct words of the whole text, folded and without punctuation at their ends, the
first four letters of words, the marks at words' ends, and the share of distinct words in steps; hashed
to ``SPACE`` bins.  Bins that too few sampled rows use, or that do not tell the grades apart, keep weight
zero, so the length of a text alone does not move its score.  The model is fitted on a bounded sample of
labelled rows, ``SAMPLE_ROWS`` at most, drawn by a hash of their ids; every fifth of them calibrates the
selection.

A bin needs ``LEAST_ROWS`` sampled rows and a deviation of ``LEAST_Z``, fixed numbers: with few labels,
below some hundreds of rows, rare words get no weight, and what only they show passes.

Defined cases: a null or empty text has the single feature of an empty text; texts of any length count
whole; without graded rows of at least two grades, or without documents, every document is selected, with
expected grade and probability null; an id that is repeated is learned from once, by its least features
and grade, and its rows are judged each; ties at the threshold are kept; a null ``toxic`` counts as 0, rows
with a null ``quality`` are not learned from; other columns are kept by ``filter_documents`` and ignored
otherwise; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_column, slices

SPACE = 1 << 18
SAMPLE_ROWS = 6000
GRADES = 3
LEAST_ROWS, LEAST_Z = 8, 6.0
#: Share of the calibration rows of the highest grade that selection keeps.
KEEP = 0.995
_ENDS = b".,;:!?\"'()[]#*$%&|<>"


#: Words whose bins a worker remembers, and bytes of a word that is remembered.
MOST_MET, MET_BYTES = 50_000, 64


def _bins(word: bytes) -> tuple[int, ...]:
    """Bins of a word as it stands in the text."""
    bare = word.strip(_ENDS).lower()
    tail = word[len(word.rstrip(_ENDS)) :]
    out = []
    if bare:
        out.append(zlib.crc32(b"w" + bare) % SPACE)
        out.append(zlib.crc32(b"p" + bare.decode("utf-8", "ignore")[:4].encode()) % SPACE)
    if tail and tail not in (b".", b","):
        out.append(zlib.crc32(b"t" + tail) % SPACE)
    return tuple(out)


def features(text: str) -> np.ndarray:
    """Bins of a whole text, each once."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.array([zlib.crc32(b"empty") % SPACE], np.int32)
    distinct = set(words)
    met = held("quality classifier")
    if len(met) > MOST_MET:
        met.clear()
    get = met.get
    found: set[int] = set()
    for w in distinct:
        b = get(w)
        if b is None:
            b = _bins(w)
            if len(w) <= MET_BYTES and len(met) <= MOST_MET:
                met[w] = b
        found.update(b)
    step = int(8 * len(distinct) / len(words) ** 0.9)
    found.add(zlib.crc32(b"d%d" % step) % SPACE)
    return np.fromiter(found, np.int32, len(found))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows])

    def grades(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of the highest grade."""
        upper = 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))  # P(grade > k)
        return upper.sum(axis=1), upper[:, -1]


def train(rows: list[np.ndarray], grade: np.ndarray, steps: int = 800) -> Model | None:
    present = np.unique(grade)
    if len(present) < 2:
        return None
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    bins = np.concatenate(rows)
    # bins that tell one grade from the rest
    used = np.bincount(bins, minlength=SPACE).astype(np.float64)
    keep = np.zeros(SPACE, bool)
    for g in present:
        p = (grade == g).mean()
        of = np.bincount(bins, weights=(grade == g)[row], minlength=SPACE)
        z = np.abs(of - used * p) / np.sqrt(np.maximum(used * p * (1 - p), 1e-9))
        keep |= (used >= LEAST_ROWS) & (z >= LEAST_Z)
    chosen = np.flatnonzero(keep)
    number = np.full(SPACE, -1)
    number[chosen] = np.arange(len(chosen))
    inside = keep[bins]
    row, column = row[inside], number[bins[inside]]
    weights, thresholds = np.zeros(len(chosen)), np.array([np.log((grade <= k).mean() + 1e-3) - np.log((grade > k).mean() + 1e-3) for k in range(GRADES - 1)])
    momentum = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(thresholds), np.zeros_like(thresholds)]
    for t in range(1, steps + 1):
        s = np.bincount(row, weights=weights[column], minlength=n)
        upper = 1 / (1 + np.exp(np.clip(thresholds[None, :] - s[:, None], -30, 30)))
        cum = np.concatenate([np.ones((n, 1)), upper, np.zeros((n, 1))], axis=1)
        mass = np.maximum(cum[np.arange(n), grade] - cum[np.arange(n), grade + 1], 1e-9)
        slope = upper * (1 - upper)
        lower, over = np.concatenate([np.zeros((n, 1)), slope], axis=1)[np.arange(n), grade], np.concatenate([slope, np.zeros((n, 1))], axis=1)[np.arange(n), grade]
        ds = (over - lower) / mass  # of minus the log likelihood, by the score
        dt = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            dt[k] = (np.where(grade == k + 1, slope[:, k] / mass, 0) - np.where(grade == k, slope[:, k] / mass, 0)).mean()
        dw = np.bincount(column, weights=ds[row], minlength=len(chosen)) / n + 1e-5 * weights
        for x, g, m, v in ((weights, dw, momentum[0], momentum[1]), (thresholds, dt, momentum[2], momentum[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        thresholds[:] = np.maximum.accumulate(thresholds)
    full = np.zeros(SPACE, np.float32)
    full[chosen] = weights
    return Model(full, thresholds.copy(), 0.5)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    graded = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).select(F.col(id_col).alias("rg_id"), ((F.col("quality") >= 1).cast("int") + (toxic < 1).cast("int")).alias("rg_grade"))
    chosen = graded.groupBy("rg_id").agg(F.min("rg_grade").alias("rg_grade")).orderBy(F.xxhash64("rg_id"), "rg_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("rg_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "rg_id").select("rg_id", "rg_grade", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array([np.sort(features(t)).tobytes() for t in texts], pa.binary())], ["id", "grade", "bins"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, grade int, bins binary")
    # one row for each sampled id, however often it is repeated
    got = found.groupBy("id").agg(F.min(F.struct("bins", "grade")).alias("x")).select("id", "x.grade", "x.bins").toPandas().sort_values("id", kind="stable")
    if not len(got):
        return None
    sample = [np.frombuffer(b, np.int32) for b in got["bins"]]
    grade = got["grade"].to_numpy(np.int64)
    check = np.arange(len(sample)) % 5 == 4
    model = train([r for r, c in zip(sample, check) if not c], grade[~check])
    if model is None:
        return None
    _, tail = model.grades(model.score([r for r, c in zip(sample, check) if c]))
    best = np.sort(tail[grade[check] == GRADES - 1])
    if len(best):
        model.cut = float(min(0.5, best[int((1 - KEEP) * len(best))]))
    return model


def _judged(m: Model | None, texts: list[str]) -> tuple[list, list, np.ndarray]:
    if m is None:
        return [None] * len(texts), [None] * len(texts), np.ones(len(texts), bool)
    expected, tail = m.grades(m.score([features(t) for t in texts]))
    return expected.tolist(), tail.tolist(), tail >= m.cut


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Expected grade, probability of the highest grade, and selection of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SPACE weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in slices(batches, text_col):
            expected, tail, kept = _judged(m, texts)
            yield pa.RecordBatch.from_arrays([id_column(batch, id_col), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(kept)], ["id", "expected_grade", "p_high", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, expected_grade double, p_high double, kept boolean").withColumnRenamed("id", id_col)


def filter_documents(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that are selected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in slices(batches, text_col):
            yield batch.filter(pa.array(_judged(m, texts)[2]))

    return docs.mapInArrow(run, docs.schema)
