"""The pipeline's stages, each on its own input, and as a whole."""

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__
from reelgraph.llm import quality_classifier, quality_rules, simhash_dedup, source_mixing

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = {name: f(spark, docs, SF) for name, f in stages.items()}
    for name in list(stages)[:-1]:
        assert set(out[name].columns) == set(docs.columns), name
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(out["quality classifier"]) == ids(quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).where("kept"))
    assert ids(out["quality rules"]) == ids(quality_rules.judge(docs, quality_rules.fit(docs, labels)).where("kept"))
    assert ids(out["simhash near-dedup"]) == ids(simhash_dedup.near_duplicates(docs).where("doc_id = component_id"))
    copies = {r["doc_id"]: r["copies"] for r in source_mixing.mix_sizes(docs).collect()}
    assert ids(out["source mixing"]) == sorted(i for i, c in copies.items() for _ in range(c))


def test_run_and_registration(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_pipeline_on_an_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_scratch_tables_are_dropped(spark):
    """After a run only the last stage's table is left, and nothing after ``drop_scratch``."""
    import os

    from reelgraph.llm import queries
    from reelgraph.shared import drop_scratch, shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    left = lambda: [n for n in os.listdir(folder) if n.startswith("reelgraph-")]
    drop_scratch(spark)
    assert not left()
    got = corpus_pipeline.run(spark, SF)
    assert len(left()) == 1 and got.count() > 0
    for name in ("op5_simhash", "op6_topk", "op7_token_output", "op10_mixing"):
        assert queries.QUERIES[name](spark, SF).count() > 0
        assert len(left()) <= 6
    drop_scratch(spark)
    assert not left()


def test_stages_bear_nulls_repeats_long_texts_and_clashing_columns(spark, texts):
    from .conftest import SCHEMA

    rows = [(i, t, None, ("a", None)[i % 2], None) for i, t in texts.items()] * 2 + [(None, None, None, None, None), (None, texts[20], "en", "a", 3), (5, texts[21], "de", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("fp", "id", "score", "kept", "size", "target", "n_tokens", "word", "quality"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = {repr(r) for r in out.collect()}
        assert got <= {repr(r) for r in docs.collect()}, name
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.count() == len(rows)
