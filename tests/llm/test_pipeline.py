"""The stages of the corpus pipeline, each held against what it must keep."""

import tracemalloc

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tilewright.llm import kernel, mixing
from tilewright.llm.store import materialise, small_table

from .test_llm import base_spans, shingles, union_find, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(1))
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = materialise(stage(spark, docs, SF), "stage")
    return [*out, docs]


def test_columns_and_order(outputs):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near-dedup", "decontaminate", "secrets", "mix"]
    assert all(x.columns == outputs[0].columns for x in outputs[:5])


def test_filters(spark, outputs):
    ids = [sorted(r.doc_id for r in x.select("doc_id").collect()) for x in outputs[:5]]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fine = [i for i in ids[0] if i in labels and labels[i].quality and not labels[i].toxic]
    assert sum(i in ids[1] for i in fine) >= 0.95 * len(fine)
    seen = {r.doc_id: r.text for r in outputs[1].collect()}
    kept = {r.doc_id for r in outputs[2].collect()}
    rows = [(i, t) for i, t in seen.items()]


    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = union_find(sets, links)
    assert kept == {i for i in root if root[i] == i} and ids[2] == sorted(kept)
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[3] == [i for i in ids[2] if not any(100 * len(x & sets[i]) >= 75 * len(x) for x in items)] and ids[4] == ids[3]


def test_secrets_are_gone_and_the_rest_stays(outputs):
    before, after = ({r.doc_id: r for r in x.collect()} for x in outputs[3:5])
    assert not any(base_spans(r.text) for r in after.values())
    assert all(after[i].text == r.text for i, r in before.items() if not base_spans(r.text) and "[secret]" not in (after[i].text or ""))
    assert all(r.n_chars == (None if r.text is None and before[i].n_chars is None else len(r.text or "")) for i, r in after.items() if r.text is not None)


def test_mix(outputs):
    taken = mixing.taken(outputs[4]).agg(F.sum("taken")).first()[0]
    blocks = outputs[5].collect()
    assert sum(b.n_words for b in blocks) == taken and all(len(words(b.text)) == b.n_words for b in blocks)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "stage")
    assert not docs.collect()


def test_small_tables_need_no_python_workers(spark):
    rows = [(0, None, 5, 0.5), (1, "é", 2**40, 1.0)]
    found = small_table(spark, rows, "ix int, name string, n bigint, share double")
    assert [tuple(r) for r in found.collect()] == rows and found.dtypes == [("ix", "int"), ("name", "string"), ("n", "bigint"), ("share", "double")]
    assert small_table(spark, [], "ix int, name string").count() == 0
    for table in (found, mixing.with_index(spark.range(2).selectExpr("cast(id as string) AS source"), [mixing.Source("0", 1, 1.0, 1, 1)])):
        assert "ExistingRDD" not in table._jdf.queryExecution().toString()


def test_temporary_arrays_are_small():
    texts = kernel.Texts(pa.array(["some words of a text that goes on " * 30] * 4000))
    tracemalloc.start()
    for first, last in texts.parts():
        kernel.Words(texts, first, last, kernel.NOT_SPACE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # 54 MB with pieces of 1 MB
