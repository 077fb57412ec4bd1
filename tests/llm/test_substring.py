import random

import pytest

from asterloom.llm import substring
from asterloom.llm.common import table
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in substring.dedup_substrings(df, **options).collect())


def test_against_brute_force_on_real_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    got = sorted(tuple(r) for r in substring.dedup_substrings(docs).collect())
    assert got == brute.substring([tuple(r) for r in docs.collect()])
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def test_planted_windows_and_odd_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdéß", k=rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, short = text(36), text(34)
    rows = [(i, text(rng.randint(0, 60)) + " " + passage + "\n\t" + text(20)) for i in range(12)]
    rows += [(20 + i, text(30) + " " + short + " " + text(30)) for i in range(5)]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "a"), (44, "same " * 200), (45, "same " * 34), (46, " ".join(["x", "y"] * 80))]
    rows += [(50, text(100))] * 2 + [(51, text(40_000))]
    assert run(spark, rows) == brute.substring(rows)


def test_separators_are_only_the_named_ones(spark):
    rows = [(i, " a b " * 40 + chr(0x1C) + "z") for i in range(2)] + [(3, "a\x0bb\x0cc\rd\te\nf" * 30)]
    assert run(spark, rows) == brute.substring(rows)


@pytest.mark.parametrize("window,gram", [(5, 2), (8, 8), (12, 3)])
def test_other_windows(spark, window, gram):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 30)))) for i in range(40)]
    assert run(spark, rows, window=window, gram=gram, batches=3) == brute.substring(rows, window)


def test_small_flushes_combine_and_meet(spark, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH", 10)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 30)))) for i in range(60)]
    assert run(spark, rows, window=6, gram=3) == brute.substring(rows, 6)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b", 5, "x", 7)], SCHEMA + ", key int, starts string, fps int")
    assert [tuple(r)[:3] for r in substring.dedup_substrings(df).collect()] == [(1, 2, 0)]


def test_kept_text(spark):
    rows = [(1, "a b c d"), (2, "z  a b c\n q")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.kept_text for r in substring.dedup_substrings(df, window=3, gram=2, with_text=True).collect()}
    assert got == {1: "d", 2: "z q"}


def test_index_ingests_batch_by_batch_and_compacts(spark, tmp_path):
    path = str(tmp_path / "index")
    probe = spark.createDataFrame([(7, "a b c"), (8, "n m o"), (9, "x y z")], "key long, text string")
    seen = []
    for i, text in enumerate(["a b c d", "x y z", "n m", "a b c", "x y q", "n m o"]):
        # Opened again for every batch, as if on another day.
        index = substring.FingerprintIndex.open(spark, path, window=3, gram=2)
        index.ingest(spark.createDataFrame([(i, text)], SCHEMA))
        assert len(index.runs()) <= substring.FANOUT and (index.runs()[0][0], index.runs()[-1][1]) == (0, i)
        seen.append(sorted(r.key for r in index.probe(probe).collect()))
    assert seen[:3] == [[], [], []] and seen[3] == [7] and 9 in seen[4] + [9] and 7 in seen[5]
    before = index.runs()
    index.compact()
    assert len(before) >= 1 and len(index.runs()) == 1
    assert sorted(r.key for r in index.probe(probe).collect()) == seen[5]
    index.drop()
    assert index.runs() == [] and index.probe(probe).count() == 0


def test_a_merged_run_replaces_its_parts_before_they_are_deleted(spark, tmp_path):
    import shutil

    path = tmp_path / "index"
    index = substring.FingerprintIndex(spark, str(path), window=3, gram=2)
    for i, text in enumerate(["a b c d", "x y z a b c"]):
        index.ingest(spark.createDataFrame([(i, text)], SCHEMA))
    first = next(p for p in path.iterdir() if p.name.startswith("run-0-0"))
    shutil.copytree(first, tmp_path / "kept")
    index.compact()
    shutil.copytree(tmp_path / "kept", first)
    assert [r[:2] for r in index.runs()] == [(0, 1)]


def test_history_is_not_exchanged(spark, tmp_path):
    index = substring.FingerprintIndex(spark, str(tmp_path / "index"), window=3, gram=2)
    for i in range(2):
        index.ingest(spark.createDataFrame([(i, f"a b c {i}")], SCHEMA))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new, old = (index._table("run", of) for of in index.runs())
        plan = new.join(old, "fp", "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
