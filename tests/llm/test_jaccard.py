import random

import numpy as np

from asterloom.llm import jaccard
from asterloom.llm.common import table
from asterloom.llm.components import components
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def run(spark, rows):
    return sorted(tuple(r) for r in jaccard.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect())


def near_copies(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice("pqrst") * 3
        yield " ".join(w)


def fixture(rng):
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(1, 5)))
    texts = []
    for size in (6, 7, 9, 12, 20, 33, 60, 90, 200, 700):
        texts += near_copies(rng, [word() for _ in range(size)], 14, max(1, size // 20))
    passage = [word() for _ in range(50)]
    texts += [" ".join([*passage, *(word() for _ in range(rng.randint(2, 40)))]) for _ in range(40)]
    texts += ["one two three", "ONE two\tthree", "one two three four", "", " \n", None, "A", "a", "x " * 500, "x " * 400, "é É"]
    return list(enumerate(texts))


def test_against_brute_force_on_real_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    got = sorted(tuple(r) for r in jaccard.similar_documents(docs).collect())
    assert got == brute.jaccard([tuple(r) for r in docs.collect()])
    assert any(r[0] != r[2] for r in got)


def test_against_brute_force_at_many_sizes(spark):
    rows = fixture(random.Random(5))
    assert run(spark, rows) == brute.jaccard(rows)


def test_large_groups_hide_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "FLUSH", 50)
    rows = fixture(random.Random(6))
    assert run(spark, rows) == brute.jaccard(rows)


def far_copies(rng, n, size=110):
    """Copies of one text with 0 to 15 words put in, taken out or replaced: most are linked with few others."""
    base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 15)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = ["".join(rng.choices("klmnop", k=7))] * rng.randint(0, 1)
        yield " ".join(w)


def test_a_large_group_in_many_components(spark):
    rows = list(enumerate([*far_copies(random.Random(3), 400), *far_copies(random.Random(4), 30, 40)]))
    random.Random(9).shuffle(rows)
    want = brute.jaccard(rows)
    assert len({r[2] for r in want}) > 40
    assert run(spark, rows) == want


def test_members_of_a_large_group_that_meet_grow_with_the_group(spark):
    # 5,000 members far from their leader and from each other: every one alone has most of what sets it apart.
    def met(m):
        rng = random.Random(m)
        rows = [(1, 2, 100, i, 100, 40, False, i, [*(1_000 * i + 200 + j for j in range(20)), *sorted(rng.sample(range(100), 6))], [0] * 4) for i in range(10, m)]
        rows.append((1, 2, 100, 5, 100, 6, True, 1, [10**9, 10**9 + 1, 10**9 + 2, *range(3)], [0] * 4))
        far = spark.createDataFrame(rows, "leader long, ld long, leader_n long, rep long, n long, apart long, linked boolean, `in` long, first array<long>, fold array<long>")
        return jaccard._meetings(far, 4, 5, 8).count()

    assert met(5_000) <= 5_000


def test_repeated_rows_and_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "a b"), (1, "a b"), (2, "A b")]) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert run(spark, [(3, None)]) == [(3, 0, 3)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2, 3), (2, "a b", 1, 2, 3)], SCHEMA + ", n int, d1 int, component long")
    assert sorted(tuple(r) for r in jaccard.similar_documents(df).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_pigeonhole_holds_for_every_size():
    bands = jaccard.Bands(4, 5)
    n = np.arange(1, 20_000)
    largest = n * 5 // 4
    assert (bands.parts[bands.of(n)] > bands.differ(n, largest)).all()
    # A partner is in the band of the smaller set or the next one.
    assert (bands.of(largest) - bands.of(n) <= 1).all()


def test_similar_sets_share_as_many_entries_as_promised():
    rng, bands = np.random.default_rng(4), jaccard.Bands(4, 5)
    for n in (1, 3, 8, 30, 90, 146, 350, 1000):
        for size in (n, n * 5 // 4):
            both = -(-4 * (n + size) // 9)  # the fewest common hashes of a pair that links
            if both > n:
                continue
            h = np.unique(rng.integers(0, 1 << 63, n + size - both, dtype=np.uint64))
            sets = np.sort(h[:both].tolist() + h[both:n].tolist()), np.sort(h[:both].tolist() + h[n:].tolist())
            keys, least = [], []
            for x in sets:
                x, row, m = x.astype(np.uint64), np.zeros(len(x), np.int64), np.array([len(x)])
                keys.append({int(k) for key, _ in jaccard._entries(row, x, np.zeros(1, np.int64), m, bands) for k in key})
                least.append(int(jaccard.least_shared(row, x, m, bands)[0]))
            assert len(keys[0] & keys[1]) >= max(least) >= 1


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (9, 2), (2, 9)] + [(1000, 1001 + i) for i in range(50)]
    links += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.component_of(sorted({n for x in links for n in x}), links)
    assert got == {n: c for n, c in want.items() if n != 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
