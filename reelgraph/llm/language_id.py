"""Language identification with a string kernel.

Two texts are compared by the byte n-grams of one to three bytes that both hold, out of the geometric
mean of their numbers (a blended-spectrum presence kernel, n-grams hashed to ``SPACE`` bins).  The kernel
matrix is approximated from ``LANDMARKS`` texts (Nystroem); one ridge regression per language, against
the rest, is solved in that space.  Texts are scored in batches: presence matrix by landmark matrix, by
the two small factors.

The model is fitted on a bounded sample: of each language the ``PER_LANGUAGE`` rows that come first by a
hash of their ids, ``SAMPLE_ROWS`` rows at most, without the rows held out.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is everything if no
labelled row can be learned from; a row without an id is not held out and not learned from; texts of any
length count whole; an id that is repeated is learned from once for each of its languages and its rows are
predicted each; of equal scores the language that comes first is taken; other columns, whatever their
names, are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, id_column, slices

SPACE = 1 << 15
LANDMARKS, PER_LANGUAGE, SAMPLE_ROWS = 64, 250, 4000
RIDGE = 1e-3
BATCH = 96
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """Which bins the n-grams of a text fall into."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(SPACE, np.uint8)
    out[codes] = 1
    pair = codes[:-1] << np.uint32(8) | codes[1:]
    triple = pair[:-1] << np.uint32(8) | codes[2:]
    for gram, factor in ((pair, 2654435761), (triple, 2246822519)):
        out[(gram * np.uint32(factor)) >> np.uint32(17)] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # SPACE x landmarks, each column scaled to length one
    factor: np.ndarray  # landmarks x languages
    offset: np.ndarray

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        size = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return (x @ self.landmarks) / size

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self.kernel(rows).astype(np.float64) @ self.factor + self.offset


def train(rows: np.ndarray, languages: list[str]) -> Model:
    names = sorted(set(languages))
    y = np.array([[1.0 if n == label else -1.0 for n in names] for label in languages])
    by_language = [[i for i, label in enumerate(languages) if label == n] for n in names]
    order = [group[k] for k in range(max(map(len, by_language))) for group in by_language if k < len(group)]
    chosen = rows[order[: max(LANDMARKS, 2 * len(names))]].astype(np.float32)
    model = Model(names, np.ascontiguousarray((chosen / np.sqrt(chosen.sum(axis=1, keepdims=True))).T), np.zeros((len(chosen), len(names))), np.zeros(len(names)))
    inner = model.kernel(chosen).astype(np.float64)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    z = np.concatenate([model.kernel(rows[i : i + BATCH]) for i in range(0, len(rows), BATCH)]).astype(np.float64) @ root
    mean, target = z.mean(axis=0), y.mean(axis=0)
    zc = z - mean
    weights = np.linalg.solve(zc.T @ zc + RIDGE * len(rows) * np.eye(z.shape[1]), zc.T @ (y - target))
    model.factor, model.offset = root @ weights, target - mean @ weights
    return model


def held_out(id_column_) -> F.Column:
    return F.coalesce(F.crc32(id_column_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    rows = docs.select(F.col(id_col).alias("rg_id"), F.col(lang_col).alias("rg_lang"), F.col(text_col).alias("text"))
    learn = rows.where(F.col("rg_id").isNotNull() & F.col("rg_lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("rg_id")))
    order = Window.partitionBy("rg_lang").orderBy(F.xxhash64("rg_id"), "rg_id")
    ids = learn.select("rg_id", "rg_lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    ids = ids.orderBy("place", "rg_lang").limit(sample_rows).select("rg_id", "rg_lang").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language id")
        for batch, texts in slices(batches):
            bits = [np.packbits(presence(t)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array([has_letter(t) for t in texts])], ["id", "lang", "bits", "letters"])

    kind = docs.schema[id_col].dataType.simpleString()
    sample = learn.join(F.broadcast(ids), ["rg_id", "rg_lang"]).select("rg_id", "rg_lang", "text").mapInArrow(run, f"id {kind}, lang string, bits binary, letters boolean").where("letters")
    # one row for each sampled id and language, however often it is repeated
    sample = sample.groupBy("id", "lang").agg(F.min("bits").alias("bits")).toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["id", "lang"], kind="stable")
    return train(np.unpackbits(np.frombuffer(b"".join(sample["bits"]), np.uint8).reshape(len(sample), -1), axis=1), sample["lang"].tolist())


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language and score (0 to 1) of every row; whether the row was held out from learning."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SPACE x LANDMARKS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language id")
        m = shared.value
        for batch, texts in slices(batches, text_col):
            found: list[str] = []
            score: list[float] = []
            for i in range(0, len(texts), BATCH):
                part = texts[i : i + BATCH]
                if m is None:
                    found += [UNKNOWN] * len(part)
                    score += [0.0] * len(part)
                    continue
                s = m.scores(np.stack([presence(t) for t in part]))
                best = s.argmax(axis=1)
                for t, b, value in zip(part, best.tolist(), s[np.arange(len(part)), best].tolist()):
                    known = has_letter(t)
                    found.append(m.languages[b] if known else UNKNOWN)
                    score.append(min(1.0, max(0.0, (value + 1) / 2)) if known else 0.0)
            yield pa.RecordBatch.from_arrays([id_column(batch, id_col), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
