"""Registered queries with SQL equal DuckDB; the pipeline equals its stages run by hand."""

import hashlib

import pytest
from compare import assert_same, connect

import __spark_entry__ as entry
import corpus_pipeline
from wavetally.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf).toPandas(), connect(sf), queries.ORACLE_SQL[name])


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept, seen = docs.columns, docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == columns, name
        seen.append(kept.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.7 * seen[0]
    from tokenizers import Tokenizer
    from wavetally.llm.bpe import default_vocabulary

    t = Tokenizer.from_file(default_vocabulary())
    want = {}
    for r in kept.collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_on_an_empty_table(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
