"""Ids pass as they are: beyond 2 ** 53, beside nulls and repeated, through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavetally.llm import bpe, decontaminate, langid, linededup, lmscore, pii, secrets, simhash, topk, warc

BIG = 1 << 60
IDS = [BIG + 1, None, BIG + 3, BIG + 3, -BIG - 1, 0, 7]


@pytest.fixture(scope="module")
def docs(spark):
    text = "the cat sat on the mat number {} and then went to see the dog at the house of the old man near the sea"
    rows = [(i, text.format(i), "en", f"s{k}", BIG + k if k % 2 else None) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


OPERATORS = {
    "op2": simhash.near_duplicate_classes,
    "op5": pii.personal_data,
    "op6": secrets.secrets,
    "op7": bpe.token_digests,
    "encode": bpe.encode_documents,
    "op8": linededup.without_spread_lines,
    "op9": lmscore.backoff_scores,
    "op10": langid.identify,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(docs, name):
    got = [r.doc_id for r in OPERATORS[name](docs).select("doc_id").collect()]
    assert sorted(got, key=str) == sorted(IDS, key=str)


def test_component_ids(docs):
    assert {r.component_id for r in simhash.near_duplicate_classes(docs.withColumn("text", F.lit("a b c d e"))).collect()} == {-BIG - 1}


def test_pages(spark):
    html = "x" * 200
    pages = spark.createDataFrame([(BIG + 1, "u", html), (BIG, "u", html), (None, "u", html), (BIG + 3, None, html), (5, "u", None), (BIG + 5, "u", html + "y")], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect()}
    assert got == {BIG: ("response", None), BIG + 1: ("revisit", BIG), None: ("revisit", BIG), BIG + 3: ("revisit", BIG), 5: ("response", None), BIG + 5: ("response", None)}


def test_items(spark, docs):
    items = spark.createDataFrame([(BIG + 9, "went to see the dog at the house of the old man near the sea")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(IDS, key=str) and {r.item_id for r in got} == {BIG + 9}


def test_vectors(spark):
    rows = spark.createDataFrame([(20 * BIG // 32, [1.0, 2.0]), (BIG + 1, [1.0, 1.0]), (BIG + 3, [1.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in topk.top_k(rows).orderBy("query_id", "rank").collect() if r.query_id == 20 * BIG // 32] == [(20 * BIG // 32, BIG + 1), (20 * BIG // 32, BIG + 3)]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "benchmark_decontamination"])
def test_stages_keep_every_value(spark, sf, docs, name):
    docs = docs.withColumn("mark", F.col("n_chars"))
    got = stage(name)(spark, docs, sf).select("doc_id", "mark").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r.doc_id, r.mark) for r in docs.collect()], key=str)


def test_near_copy_stage(spark, sf, docs):
    (got,) = stage("simhash_near_dedup")(spark, docs.withColumn("text", F.lit("one two three four five six seven")), sf).collect()
    assert (got.doc_id, got.n_chars) == (-BIG - 1, None)
