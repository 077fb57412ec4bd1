"""The pipeline's stages, each on what the one before kept, against plain checks."""

import pytest

import corpus_pipeline
from asterloom.llm import jaccard, toxicity
from asterloom.llm.common import table
from tests.llm import brute
from tests.llm.test_secrets import plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, FOLDER, "documents"), {"documents": table(spark, FOLDER, "documents")}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns_stay(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_each_stage_takes_effect(spark, stages):
    texts = lambda n: {r.doc_id: r.text for r in stages[n].collect()}
    scores = toxicity.score_toxicity(stages["documents"], table(spark, FOLDER, "labels"))
    assert set(texts("toxicity")) == {r.doc_id for r in scores.collect() if not r.predicted}
    want = {i for i, _, c in brute.jaccard(list(texts("toxicity").items())) if i == c}
    assert set(texts("jaccard_join")) == want
    assert not any(sum(plain(t)[0]) for t in texts("secret_scan").values())
    before = texts("jaccard_join")
    assert all(t == before[i] for i, t in texts("secret_scan").items() if "<secret>" not in t)
    assert {r.n_chars - len(r.text) for r in stages["secret_scan"].collect()} == {0}
    assert set(texts("source_mix").values()) <= set(texts("secret_scan").values())
    copies = stages["source_mix"].groupBy("doc_id").count().collect()
    assert all(r["count"] <= 3 for r in copies)
    assert {r.doc_id for r in stages["best_fit_packing"].collect()} == {r.doc_id for r in copies}


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages["best_fit_packing"].select(*got.columns).collect()))
    assert jaccard.SMALL and corpus_pipeline.ORACLE_SQL is None
