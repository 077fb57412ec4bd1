"""Rows that a stage must not lose: without id or text, repeated, and with columns of clashing names."""

import pytest

import corpus_pipeline
from asterloom.llm import mixing

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, `row` string, times int, size int, copy int, _times int, h long"
LONG = "one two three four five six seven eight nine ten " * 12_000


def text(i, n=40):
    return " ".join(f"w{i}x{j}" for j in range(n))


ROWS = [
    (1, text(1)), (1, text(1)), (1, text(1)), (None, text(2)), (None, text(3)), (None, None), (4, None), (5, ""), (6, " \n"), (7, LONG), (8, text(8)), (8, text(9)),
    (10, text(1)), (2, text(10)), (11, text(10) + " more"), (None, text(10) + " again"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if n % 5 == 0 else "ab"[n % 2], len(t or ""), n, "x", 7, 8, 9, 10, 11) for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def pairs(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in df.select("doc_id", "text").collect()))


def test_near_copies_keep_one_row_of_each_group_and_all_others(spark, docs):
    got = stage("jaccard_join")(spark, docs, FOLDER)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    want = [(1, text(1)), (None, text(2)), (None, text(3)), (None, None), (4, None), (5, ""), (6, " \n"), (7, LONG), (8, text(8)), (8, text(9)), (2, text(10))]
    assert pairs(got) == sorted((i is None, i or 0, t or "", t is None) for i, t in want)


def test_toxicity_and_secrets_keep_clean_rows(spark, docs):
    assert pairs(stage("toxicity")(spark, docs, FOLDER)) == pairs(docs)
    got = stage("secret_scan")(spark, docs, FOLDER)
    assert got.columns == docs.columns and pairs(got) == pairs(docs)


def test_the_mix_repeats_rows_by_what_they_take(spark, docs):
    mixed = mixing.mix(docs)
    assert mixed.count() == len(ROWS)
    took = {}
    for r in mixed.collect():
        took.setdefault((r.doc_id, r.skey, r.h), set()).add(r.times)
    assert all(len(t) == 1 for t in took.values())  # equal rows come equally often
    got = stage("source_mix")(spark, docs, FOLDER)
    assert got.columns == docs.columns
    assert got.count() == sum(r.times for r in mixed.collect())
    assert mixing.repeat(docs.filter("text is null or length(text) < 3")).count() == 4  # no words at all: once each


def test_equal_sources_keep_every_row(spark):
    rows = [(i, t, "en", "one", 0) for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert pairs(mixing.repeat(docs)) == pairs(docs)


def test_packing_keeps_rows_without_id_or_text(spark, docs):
    got = stage("best_fit_packing")(spark, docs, FOLDER).collect()
    assert sum(r.piece == 0 for r in got) == len(ROWS)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for name, run in corpus_pipeline.STAGES:
        got = run(spark, none, FOLDER)
        assert got.count() == 0 and (name == "best_fit_packing" or got.columns == docs.columns)
