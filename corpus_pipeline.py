"""A training-data pipeline of corpus operators: classify, clean, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Models are fitted on the rows that the stage is given and the labels of ``sf_dir``.

Defined cases, for every stage: no rows give no rows; texts of any length count whole; rows that repeat an
id are judged each; a null ``lang`` or ``n_chars`` is passed on; other columns, whatever their names, are
passed on by all stages but the last.  What a stage does with null ids, null texts and ties stands at it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelgraph.llm import quality_classifier, quality_rules, sentencepiece_codec, simhash_dedup, source_mixing
from reelgraph.llm.common import drop_scratch, read_table, scratch_path
from reelgraph.llm.queries import PIECES

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects.

    A null text is judged as an empty one; a null id changes nothing; a probability equal to the threshold is
    kept; without labels of two grades all documents are kept.
    """
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.filter_documents(docs, model)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep.

    A null or empty text fails the base rules and goes; a null id changes nothing; a score equal to the
    threshold is kept; with few labels the base rules alone decide.
    """
    forest = quality_rules.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.filter_documents(docs, forest)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id.

    Rows that repeat the smallest id stay all; rows without an id stay; documents without words, null texts
    among them, are one component.
    """
    return simhash_dedup.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Rows without a source are a source of their own; a null text has no words and takes part as a document
    of one; rows without an id are told apart by their texts; equal places in the ranking are taken or left
    together.
    """
    return source_mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoding digests of the mixed documents, a row for each copy.

    A null text is encoded as an empty one; a null id is passed on.
    """
    return sentencepiece_codec.digest_documents(docs, PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Classifiers and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written, read again, and dropped when used.

    The last stage's table stays for the caller, until ``drop_scratch``.
    """
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        drop_scratch(spark, keep=[path])  # the stage before, and what this one needed
    return docs
