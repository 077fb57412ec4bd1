import math
import random
from collections import Counter

import numpy as np
import pytest

from asterloom.llm import bm25, token_counts
from asterloom.llm.common import table
from asterloom.llm.tokens import encoder
from tests.llm import brute


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain_search(docs, query, k):
    bags = [(i, Counter(brute.words(low(t)))) for i, t in docs]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / max(1, len(bags))
    out = []
    terms = set(brute.words(low(query)))
    idf = {t: math.log(1 + (n - df + 0.5) / (df + 0.5)) for t in terms if (df := sum(t in b for _, b in bags))}
    for i, b in bags:
        length = sum(b.values())
        s = sum(w * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t, w in idf.items() if t in b)
        if s > 0:
            out.append((-s, i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize("shard,block", [(2_000_000, 64), (300, 4)])
def test_top_k_against_scoring_all(spark, monkeypatch, shard, block):
    monkeypatch.setattr(bm25, "SHARD_WORDS", shard)
    monkeypatch.setattr(bm25, "BLOCK", block)
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    asked = table(spark, "/root/testdata/sf0.001", "benchmark").filter("item_id % 10 = 0")
    got = {}
    for r in bm25.search(bm25.build_index(docs), asked, k=7).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
    every = [tuple(r) for r in docs.collect()]
    for q in asked.collect():
        want = plain_search(every, q.text, 7)
        assert [s for _, s in got[q.item_id]] == pytest.approx([s for _, s in want])
        if len({round(s, 9) for _, s in want}) == len(want):
            assert [i for i, _ in got[q.item_id]] == [i for i, _ in want]


def test_search_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (4, "A c " * 9000, "x")], "doc_id long, text string, term string")
    ask = spark.createDataFrame([(1, "a a"), (2, None), (3, "zzz"), (4, "B")], "item_id long, text string")
    got = [(r.item_id, r.rank, r.doc_id) for r in bm25.search(bm25.build_index(docs), ask, k=3).orderBy("item_id", "rank").collect()]
    assert got == [(1, 1, 4), (1, 2, 3), (1, 3, 3), (4, 1, 3), (4, 2, 3)] or got == [(1, 1, 3), (1, 2, 3), (1, 3, 4), (4, 1, 3), (4, 2, 3)]
    assert bm25.search(bm25.build_index(docs.limit(0)), ask).count() == 0
    assert bm25.search(bm25.build_index(docs), ask.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pruning_skips_postings_and_changes_nothing(seed):
    rng = np.random.default_rng(seed)
    n = 4000
    length = rng.integers(5, 50, n)
    terms, idf = np.array([1, 2, 3], np.uint64), np.array([0.1, 2.0, 5.0])
    posts = [np.sort(rng.choice(n, m, replace=False)) for m in (3000, 400, 40)]
    doc = np.concatenate(posts)
    shard = bm25.with_blocks(np.arange(n), length, terms, np.cumsum([0, *map(len, posts)]), doc, rng.integers(1, 4, len(doc)))
    found, score, read = bm25._best(terms, idf, shard, length.mean(), 5)
    assert read < len(doc) / 4
    all_found, all_score, all_read = bm25._best(terms, idf, shard, length.mean(), n)
    assert all_read == len(doc)
    assert found.tolist() == all_found[:5].tolist() and score.tolist() == all_score[:5].tolist()


def test_blocks_hold_the_maxima():
    rng = np.random.default_rng(1)
    counts = [1, 64, 65, 200]
    doc = np.concatenate([np.sort(rng.choice(500, m, replace=False)) for m in counts])
    tf, length = rng.integers(1, 9, len(doc)), rng.integers(1, 99, 500)
    start = np.cumsum([0, *counts])
    *_, first, last, most, least = bm25.with_blocks(np.arange(500), length, np.arange(4, dtype=np.uint64), start, doc, tf)
    at = 0
    for t, m in enumerate(counts):
        assert first[t] == at
        for low in range(start[t], start[t] + m, bm25.BLOCK):
            s = slice(low, min(low + bm25.BLOCK, start[t + 1]))
            assert (last[at], most[at], least[at]) == (doc[s][-1], tf[s].max(), length[doc[s]].min())
            at += 1
    assert at == len(last)


def test_query_asks_with_whole_documents(spark):
    from asterloom.llm import queries

    docs = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    asked = {i: t for i, t in docs if i % 20 == 0}
    got = {}
    for r in queries.op5_topk_search(spark, "/root/testdata/sf0.001").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert set(got) == {i for i, t in asked.items() if brute.words(low(t))} and len(got) >= 9
    for i, found in got.items():
        want = plain_search(docs, asked[i], 10)
        assert [s for _, s in found] == pytest.approx([s for _, s in want])
        if len({round(s, 9) for _, s in want}) == len(want):
            assert [d for d, _ in found] == [d for d, _ in want]


def test_long_queries_in_blocks_and_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_WORDS", 500)
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 3)
    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(10, 60))) for _ in range(60)]
    docs = [(i, texts[i % 60]) for i in range(240)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (None, texts[2]), *((i, texts[i]) for i in range(20, 40))], "item_id long, text string")
    got = bm25.search(bm25.build_index(d), asked, k=6).collect()
    assert sum(r.item_id == 7 for r in got) == 12 and sum(r.item_id is None for r in got) == 6
    for i in range(20, 40):
        found = sorted((r.rank, r.doc_id, r.score) for r in got if r.item_id == i)
        want = plain_search(docs, texts[i], 6)
        assert [x[2] for x in found] == pytest.approx([s for _, s in want])
        assert [x[1] for x in found[:4]] == [i, i + 60, i + 120, i + 180]


def test_shards_hand_on_their_best(spark, monkeypatch):
    kept, plain = {}, bm25.written

    def written(df, what):
        kept[what] = table = plain(df, what)
        kept[what + " rows"] = table.count()
        return table

    monkeypatch.setattr(bm25, "written", written)
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(rng.choice([3, 40])))) for i in range(200)]
    index = bm25.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(12))
    assert index.count() >= 10
    got = bm25.search(index, spark.createDataFrame(docs[:30], "item_id long, text string"), k=4).collect()
    # With 8 partitions two tasks read the shards, one after the other: each gives the best of all of its shards, not of each.
    assert len(got) <= kept["bm25-best rows"] <= 30 * 4 * 2
    for i in range(30):
        found = [r.score for r in sorted((r for r in got if r.item_id == i), key=lambda r: r.rank)]
        assert found == pytest.approx([s for _, s in plain_search(docs, docs[i][1], 4)])


def test_kinds_of_text_become_shards_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(bm25, "KIND_DOCS", 20)
    rng = random.Random(5)
    docs = [(i, " ".join(f"{'abc'[i % 3]}{int(rng.paretovariate(0.6)) % 200}" for _ in range(rng.randint(9, 60))) + " all" * (i % 2)) for i in range(300)]
    counts = [len(set(t.split())) for _, t in docs]
    terms, term = np.unique([w for _, t in docs for w in sorted(set(t.split()))], return_inverse=True)
    doc = np.repeat(np.arange(300), counts)
    order = np.argsort(term, kind="stable")
    kind = bm25._kinds(300, np.r_[0, np.cumsum(np.bincount(term))], doc[order])
    assert len(set(kind)) >= 3 and all(len({i % 3 for i in np.flatnonzero(kind == x)}) == 1 for x in set(kind))
    assert len(terms) > 300 / 3 and kind.tolist() == bm25._kinds(300, np.r_[0, np.cumsum(np.bincount(term))], doc[order]).tolist()


def test_shards_and_postings_below_the_kth_score_are_passed_over():
    rng = np.random.default_rng(6)

    def shard(ids, n_terms, tf):
        posts = [np.sort(rng.choice(len(ids), len(ids) // 4, replace=False)) for _ in range(n_terms)]
        doc = np.concatenate(posts)
        return bm25.with_blocks(ids, np.full(len(ids), 100, np.int32), np.arange(n_terms, dtype=np.uint64), np.cumsum([0, *map(len, posts)]), doc.astype(np.int32), np.full(len(doc), tf))

    good, poor = shard(np.arange(400), 20, 9), shard(np.arange(400, 800), 4, 1)
    asked = bm25._Asked(np.arange(2), np.arange(2), np.array([0, 20, 35]), np.arange(20, dtype=np.uint64), rng.random(20) + 1, np.r_[0:20, 5:20].astype(np.int32), 3)
    assert bm25._Scorer(good, 100.0).meet(asked) == 2 and (asked.least > 0).all()
    before = [x.tolist() for x in asked.ids]
    assert bm25._Scorer(poor, 100.0).meet(asked) == 0 and [x.tolist() for x in asked.ids] == before
    found, _, read = bm25._best(np.arange(3, dtype=np.uint64), np.ones(3), poor, 100.0, 3, 99.0)
    assert read == len(found) == 0


ALPHABET = ["a", "b", " ", " ", "  ", "\n", "'s", "é", "1", ".", "🙂", " ", "word", " the", "\t "]


def test_few_documents_are_scored_again_after_a_shard_of_another_kind(monkeypatch):
    """A low k-th score, as texts of another kind leave it, lets only about k documents of a shard into the exact round."""
    rng, n, n_terms, k = np.random.default_rng(5), 600, 60, 5
    has = rng.random((n_terms, n)) < 0.3
    t, doc = np.nonzero(has)
    start = np.r_[0, np.cumsum(has.sum(1))]
    names = np.arange(1, n_terms + 1, dtype=np.uint64)
    shard = bm25.with_blocks(np.arange(n), has.sum(0), names, start, doc.astype(np.int32), np.ones(len(t), np.int32))
    asked = bm25._Asked(np.array([0]), np.array([0]), np.array([0, n_terms]), names, np.linspace(1, 2, n_terms), np.arange(n_terms, dtype=np.int32), k)
    asked.add(0, np.arange(n, n + k), np.full(k, 1e-3))
    met, add = [], bm25._Asked.add
    monkeypatch.setattr(bm25._Asked, "add", lambda self, i, ids, scores: (met.append(len(ids)), add(self, i, ids, scores)))
    bm25._Scorer(shard, float(has.sum(0).mean())).meet(asked)
    f, dl = 1.0, has.sum(0)
    every = (np.linspace(1, 2, n_terms)[:, None] * has * bm25._impact(f, dl, float(dl.mean()))).sum(0)
    best = np.lexsort((np.arange(n), -every))[:k]
    assert asked.ids[0].tolist() == best.tolist()
    assert np.allclose(asked.scores[0], every[best], rtol=1e-12)
    assert sum(met) <= 2 * k


def test_edits_against_encoding_the_whole_text(monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 8)
    monkeypatch.setattr(token_counts._cut, "__defaults__", (8,))
    encode = encoder()
    rng = random.Random(3)
    for _ in range(120):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 80)))
        doc = token_counts.CountedText(text, lambda s: len(encode(s)))
        assert doc.tokens == len(encode(text)) and doc.text == text
        for _ in range(8):
            a = rng.randint(-2, len(text) + 3)
            b = a + rng.choice([0, 0, 1, 3, 15])
            new = "".join(rng.choices(ALPHABET, k=rng.choice([0, 1, 2, 20])))
            x = min(max(a, 0), len(text))
            text = text[:x] + new + text[min(max(b, x), len(text)) :]
            doc.edit(a, b, new)
            assert doc.text == text and doc.tokens == len(encode(text)) and doc.length == len(text)


def test_only_touched_leaves_are_encoded_again():
    encode = encoder()
    text = "some plain words here " * 2000
    doc = token_counts.CountedText(text, lambda s: len(encode(s)))
    before = doc.encoded
    doc.edit(20_000, 20_003, "xyz")
    assert doc.encoded - before < 4 * token_counts.LEAF and doc.tokens == len(encode(doc.text))


def test_counts_query(spark):
    from asterloom.llm import queries

    encode = encoder()
    texts = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in queries.op4_token_counts(spark, "/root/testdata/sf0.001").collect():
        t = texts[r.doc_id]
        assert r.n_tokens == len(encode(t))
        for at, size, new in ((1, 0, " edited"), (2, 12, "rewritten \n"), (3, 20, "")):
            s = int(len(texts[r.doc_id]) * at / 4)
            t = t[:s] + new + t[s + size :]
        assert r.n_tokens_edited == len(encode(t))


EDITS = "array<struct<start:int,end:int,text:string>>"


def test_counts_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", [(5, 1, "a b")]), (3, "abc", [(None, None, None)]), (3, "abc", []), (4, None, [(0, 0, "new")]), (None, "abc", None)], f"doc_id long, text string, edits {EDITS}")
    trees = token_counts.counted(df.drop("edits").withColumn("chars", df.doc_id))
    assert [(r.text is None) == (r.chars is None) for r in trees.collect()] == [True] * 6
    edits = df.select(df.doc_id.alias("id"), df.text.alias("t"), "edits")
    joined = trees.distinct().join(edits, trees.doc_id.eqNullSafe(edits.id))
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_tokens_edited, r.text) for r in token_counts.edited(joined).collect()), key=str)
    assert got == [(0, 1, 1, "abc"), (1, 0, 0, None), (2, 0, 2, "a b"), (3, 1, 1, "abc"), (3, 1, 1, "abc"), (4, 0, 1, "new")]
    assert token_counts.edited(joined.limit(0)).count() == 0 and token_counts.counted(df.limit(0)).count() == 0


def test_kept_trees_are_edited_again_and_again(spark, tmp_path):
    encode, rng = encoder(), random.Random(12)
    texts = {i: "".join(rng.choices(ALPHABET, k=rng.choice([0, 3, 900, 9000]))) for i in range(12)}
    state = token_counts.counted(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    for turn in range(3):
        state.write.parquet(str(tmp_path / str(turn)))  # another day, the trees come from the table
        edits = {i: [(a := rng.randint(0, len(t)), a + rng.randint(0, 9), "".join(rng.choices(ALPHABET, k=5)))] for i, t in texts.items()}
        asked = spark.createDataFrame(list(edits.items()), f"doc_id long, edits {EDITS}")
        after = token_counts.edited(spark.read.parquet(str(tmp_path / str(turn))).join(asked, "doc_id")).cache()
        for r in after.collect():
            before = texts[r.doc_id]
            (a, b, new), = edits[r.doc_id]
            texts[r.doc_id] = before[:a] + new + before[b:]
            assert r.text == texts[r.doc_id] and r.n_tokens_edited == len(encode(r.text)) == r.tokens[1] and r.n_tokens == len(encode(before))
            assert len(before) < 4000 or r.n_chars_encoded_again < len(before) / 2
        state = after.select("doc_id", "text", "chars", "tokens")


def test_a_block_meets_a_shard_in_few_bytes_a_term():
    """What a query's term costs in a shard is mostly the arrays that pass by it: a block of many terms needs few bytes for each."""
    import tracemalloc

    rng, n, n_terms, n_queries, each = np.random.default_rng(7), 300, 3000, 2000, 150
    doc = np.concatenate([np.sort(rng.choice(n, 6, replace=False)) for _ in range(n_terms)])
    shard = bm25.with_blocks(np.arange(n), np.full(n, 60, np.int32), np.arange(n_terms, dtype=np.uint64), np.arange(0, 6 * n_terms + 1, 6), doc.astype(np.int32), np.ones(len(doc), np.int32))
    place = np.concatenate([np.sort(rng.choice(n_terms, each, replace=False)) for _ in range(n_queries)]).astype(np.int32)
    weights = rng.random(n_terms) + 1
    asked = bm25._Asked(np.arange(n_queries), np.arange(n_queries), np.arange(0, len(place) + 1, each), np.arange(n_terms, dtype=np.uint64), weights, place, 5)
    scorer = bm25._Scorer(shard, 60.0)
    tracemalloc.start()
    assert scorer.meet(asked) == n_queries
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * len(place)
    every = np.zeros(n)
    for t in place[:each]:
        every[doc[6 * t : 6 * t + 6]] += weights[t]
    best = np.lexsort((np.arange(n), -every))[:5]
    assert asked.ids[0].tolist() == best.tolist() and np.allclose(asked.scores[0], every[best], rtol=1e-12)


def test_index_rows_take_few_bytes_and_hold_every_number(spark):
    """Large arrays that pass the JVM fill its heap, so a posting takes about 3 bytes and a term about 20, not 8 and 36."""
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(300)) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(-(1 << 62), "w1 " * 70_000), (1 << 62, "w2 " * 300 + "end")]
    (row,) = bm25.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    ids, length, term, start, doc, tf, first, last, most, least = bm25._shard(row.asDict())
    assert sum(len(row[c]) for c in bm25._COLUMNS) < 6 * len(doc) + 30 * len(term) + 16 * len(ids)
    bags = [Counter(t.split()) for _, t in docs]
    assert ids.tolist() == [i for i, _ in docs] and length.tolist() == [sum(b.values()) for b in bags]
    assert len(term) == len(set().union(*bags)) and term.dtype == np.uint64 and (term[1:] > term[:-1]).all()
    assert sorted(zip(doc.tolist(), tf.tolist())) == sorted((d, n) for d, b in enumerate(bags) for n in b.values())
    for a, b, kind in zip(bm25.with_blocks(ids, length, term, start, doc, tf), bm25._shard(row.asDict()), bm25._KINDS):
        assert a.tolist() == b.tolist() and b.dtype == kind


@pytest.mark.parametrize("most", [0, 255, 256, 65_535, 65_536, (1 << 31) - 1, 1 << 31, (1 << 63) - 1])
@pytest.mark.parametrize("least", [0, -1, -(1 << 63)])
def test_numbers_are_kept_in_any_range(least, most):
    a = np.array([least, 0, most], np.int64)
    assert bm25._widened(bm25._narrowed(a), np.int64).tolist() == a.tolist()
    assert bm25._widened(bm25._narrowed(a[:0]), np.int64).tolist() == []


def test_query_gives_workers_few_texts_at_a_time(spark, monkeypatch):
    """A batch of 10,000 texts stands in the JVM and in the worker at once; the setting is put back."""
    from asterloom.llm import queries

    name, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, bm25.written

    def written(df, what, *options):
        seen[what] = int(spark.conf.get(name))
        return plain(df, what, *options)

    monkeypatch.setattr(bm25, "written", written)
    before = spark.conf.get(name)
    queries.op5_topk_search(spark, "/root/testdata/sf0.001").collect()
    assert seen["bm25-index"] <= 1000 and seen["bm25-queries"] <= 1000 and seen["bm25-best"] == 1 and spark.conf.get(name) == before
