"""The pipeline's stages on a small table: each keeps what it must, and the run matches its stages."""

import sys
from pathlib import Path

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = P.stored(spark, stage(spark, docs, SF), "step")
        kept.append(docs)
    return kept


def test_stages_keep_columns_and_clean_rows(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert all(s.columns == docs.columns for s in steps[:-1])
    assert steps[0].count() >= 0.99 * docs.count()
    good = steps[0].join(labels.filter("quality = 1"), "doc_id", "left_semi").filter(F.size(F.split("text", r"\s+")) >= 60)
    assert steps[1].join(good, "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_near_copies_leave_one_each(spark, steps):
    from test_similar import kept_by_hand

    texts = dict(map(tuple, steps[1].select("doc_id", "text").collect()))
    assert {r.doc_id for r in steps[2].collect()} == kept_by_hand(texts)


def test_mixture_repeats_as_planned(spark, steps):
    from tenora.llm import mixing

    planned = {r[0]: r[1] for r in mixing.copies(spark, steps[2]).select("row.doc_id", "copies").collect() if r[1]}
    assert planned == {r[0]: r[1] for r in steps[3].groupBy("doc_id").count().collect()}


def test_run_equals_its_stages(spark, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = P.run(spark, SF)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, steps[4].select(*columns).collect()))
    assert got.agg(F.countDistinct("sequence_id"), F.ceil(F.sum("length") / 2048)).first()[0] <= 1 + got.agg(F.ceil(F.sum("length") / 2048)).first()[0]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
