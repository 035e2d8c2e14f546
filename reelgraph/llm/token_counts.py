"""Token counts of whole texts by a compiled tokenizer.

The vocabulary is compiled into a deterministic transducer whose transitions carry the change of the
number of tokens; texts are cut into chunks, each chunk's state map is computed on its own, and the
maps are composed in a tree (``transducer.Transducer.counts``).  SentencePiece models are counted by the codec.

Defined cases: a null text counts as empty and has no tokens; a text of any length is counted whole; rows
that repeat an id are counted each, and ids may be null; a count equal to the limit is not over it; other
columns, whatever their names, are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column, slices
from .sentencepiece_codec import codec
from .word_bpe import word_bpe


def count_texts(model: str, texts: list[str]) -> list[int]:
    if model.endswith(".model"):
        return [len(ids) for ids in codec(model).encode_batch(texts)]
    return word_bpe(model).count_batch(texts)


def count_tokens(docs: DataFrame, model: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UTF-8 bytes and tokens of every row, and whether it has more tokens than ``limit``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays(
                [id_column(batch, id_col), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count_texts(model, texts), pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
