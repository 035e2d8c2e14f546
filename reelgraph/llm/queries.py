"""One query per corpus operator over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, license_scan, quality_classifier, quality_rules, sentencepiece_codec, simhash_dedup, source_mixing, token_counts, token_output, topk_search
from .common import materialize, read_table

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding of all documents."""
    return sentencepiece_codec.digest_documents(read_table(spark, sf_dir, "documents"), PIECES)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the compiled transducer."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), WORDS)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that stand in the documents."""
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of near ones."""
    found = simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every 20th."""
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ids in the binary format, and read back."""
    return token_output.round_trip(read_table(spark, sf_dir, "documents"), WORDS, end_id=2)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents, and which are selected."""
    docs = read_table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, read_table(spark, sf_dir, "labels")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of all documents and the isolation forest's verdict."""
    docs = read_table(spark, sf_dir, "documents")
    measured = materialize(quality_rules.measure(docs), "rules")
    forest = quality_rules.fit_measured(measured, read_table(spark, sf_dir, "labels"))
    return quality_rules.judge_measured(measured, forest)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to target weights by source."""
    return source_mixing.mix_sizes(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_token_counts, op3_license_scan, op4_language_id, op5_simhash, op6_topk, op7_token_output, op8_quality_classifier, op9_quality_rules, op10_mixing,
    )
}

#: The other operators need a tokenizer, a hash, an iteration or a trained model beyond SQL.
ORACLES: dict[str, str] = {
    "op6_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 j AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
 SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM j) WHERE rank <= 20""",
}
