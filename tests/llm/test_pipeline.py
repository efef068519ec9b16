"""The corpus pipeline, stage by stage against brute force on each stage's own input."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn from


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        step(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(stages):
    assert [set(after.columns) for _, after in stages[:-1]] == [set(DOCUMENTS)] * 4


def test_clean_documents_stay(spark, sf_dir, stages):
    before, after = stages[0]
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id")
    gone = before.join(after, "doc_id", "left_anti")
    assert before.count() > after.count()
    labelled = gone.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    assert labelled.join(toxic, "doc_id").count() == labelled.count()


def test_one_of_each_group_stays(stages):
    from tests.llm.test_llm import brute_components, brute_simhash

    before, after = stages[1]
    prints = {r.doc_id: brute_simhash(r.text) for r in before.collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(brute_components(prints).values()))


def test_repeated_passages_go(stages):
    from tests.llm.test_llm import brute_repeats

    before, after = stages[2]
    want = brute_repeats([(r.doc_id, r.text) for r in before.collect()])
    got = {r.doc_id: r for r in after.collect()}
    assert {i: v[3].decode("utf-8", "ignore") for i, v in want.items()} == {i: r.text for i, r in got.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_mix_nears_its_targets(stages):
    before, after = stages[3]
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    total = before.agg(F.sum(size)).head()[0]
    assert abs(after.agg(F.sum(size)).head()[0] / total - 1) < 0.25
    assert after.groupBy("doc_id").count().agg(F.max("count")).head()[0] <= 4
    assert after.join(before, DOCUMENTS, "left_anti").count() == 0


def test_encoded(stages):
    before, after = stages[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert re.fullmatch("[0-9a-f]{64}", r.ids_sha256) and r.n_tokens >= 0


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[4][1].select(*got.columns).collect()))
