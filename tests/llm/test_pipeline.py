"""The stages over the small tables, each against brute force on its own input."""

import os
import re

import pytest
from test_dedup import LOWER
from test_jaccard import brute_jaccard
from test_pii import naive

import corpus_pipeline
from wattframe.llm.pii import mask
from wattframe.llm.toxicity import score_toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]

    out = spark.createDataFrame(stages["toxicity"](spark, docs, FOLDER).collect(), docs.schema)
    scores = {r.doc_id: r.predicted for r in score_toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    clean = {r.doc_id for r in out.collect()}
    assert clean == {i for i, p in scores.items() if p == 0} and out.columns == columns

    out = spark.createDataFrame(stages["exact_dedup"](spark, out, FOLDER).collect(), docs.schema)
    last = {}
    for i in sorted(clean):
        last[(rows[i].text or "").translate(LOWER)] = i
    unique = {r.doc_id for r in out.collect()}
    assert unique == set(last.values()) and out.columns == columns

    out = spark.createDataFrame(stages["near_dedup"](spark, out, FOLDER).collect(), docs.schema)
    wanted = {c for _, c in brute_jaccard([(i, rows[i].text) for i in sorted(unique)])}
    assert {r.doc_id for r in out.collect()} == wanted and out.columns == columns

    out = spark.createDataFrame(stages["pii"](spark, out, FOLDER).collect(), docs.schema)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert set(texts) == wanted and out.columns == columns and all(texts[i] == mask(rows[i].text, naive(rows[i].text)) for i in wanted)

    packed = stages["packing"](spark, out, FOLDER).collect()
    assert sum(r.words for r in packed) == sum(len(re.findall("[^\x20\x09-\x0d]+", t)) for t in texts.values()) and {r.doc_id for r in packed} == wanted


def test_run(spark):
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.count() > 0 and {"shard", "bin", "doc_id", "piece"} <= set(packed.columns)
