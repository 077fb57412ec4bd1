import random
import zlib

import pyarrow as pa
import pytest

from asterloom.llm import toxicity
from asterloom.llm.common import table


def corpus(rng, n):
    syllable = ["an", "er", "on", "th", "re", "st", "ing", "ed", "ly", "tion"]
    word = lambda: "".join(rng.choices(syllable, k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        w = [word() for _ in range(rng.randint(30, 120))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vrxglob", "quzzmork", "plimfrack"])
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus(random.Random(8), 700)
    d, l = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, dict(labels), d, l, toxicity.fit(d, l)


def test_held_out_accuracy(learned):
    docs, labels, d, l, model = learned
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, l, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in docs)
    held = [i for i, *_ in docs if got[i].held_out]
    assert all(got[i].predicted == (got[i].score >= 0.3) and 0 <= got[i].score <= 1 for i in got)
    toxic = [i for i in held if labels[i]]
    assert sum(got[i].predicted for i in toxic) >= 0.9 * len(toxic)
    assert sum(got[i].predicted for i in held if not labels[i]) <= 0.03 * len(held)


def test_scores_depend_on_the_text_only(spark, learned):
    docs, labels, d, l, model = learned
    again = spark.createDataFrame([(i + 10_000, t, "y") for i, t, _ in docs[:50]], "doc_id long, text string, score string")
    old = {r.doc_id: r.score for r in toxicity.score_toxicity(d, l, model).collect()}
    assert all(r.score == old[r.doc_id - 10_000] for r in toxicity.score_toxicity(again, l, model).collect())


def test_dropping_agrees_with_scores(learned):
    docs, labels, d, l, model = learned
    kept = {r.doc_id for r in toxicity.drop_toxic(d, l, model).collect()}
    assert kept == {r.doc_id for r in toxicity.score_toxicity(d, l, model).collect() if not r.predicted}


def test_odd_rows_and_missing_labels(spark, learned):
    *_, l, model = learned
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, " \n"), (4, "word " * 30_000), (None, "a")], "doc_id long, text string")
    got = toxicity.score_toxicity(odd, l, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(odd.limit(0), l, model).count() == 0
    for labels, want in ([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(i, 1) for i in range(9)], 1.0):
        none = spark.createDataFrame(labels, "doc_id long, toxic int")
        text = spark.createDataFrame([(i, "some words here") for i in range(9)], "doc_id long, text string")
        assert {r.score for r in toxicity.score_toxicity(text, none).collect()} == {want}


def test_real_documents_are_better_than_chance(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels")).collect()}
    rows = [r for r in table(spark, d, "labels").collect()]
    toxic, clean = ([got[r.doc_id] for r in rows if r.toxic == k] for k in (1, 0))
    assert sum(toxic) / len(toxic) > 2 * sum(clean) / len(clean)


def test_scores_against_plain_compression(spark, learned):
    """Lengths, cells, features and score again, from one compressor call a window."""
    import math

    import zstandard as zs

    docs, labels, d, l, model = learned
    params = dict(window_log=17, hash_log=16, chain_log=17, search_log=5, min_match=3, target_length=32, strategy=zs.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(data, dictionary):
        return len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary), compression_params=zs.ZstdCompressionParameters(**params)).compress(data))

    def plain(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
        found = []
        for i in range(0, len(w), 3):
            data = (" " + " ".join(w[i : i + 3]) + " ").encode()
            a, b = length(data, model.ordinary), length(data, model.toxic)
            over = max(0, max(a, b) - 47)
            found.append(model.log_odds[max(a - over, 0) * 48 + max(b - over, 0)])
        total = sum(max(x - toxicity.NOISE, 0) for x in found)
        f = [max([0, *found]), total / math.sqrt(len(found)), math.log1p(total)] if found else [0, 0, 0]
        z = model.weights[0] + sum(w * (x - c) / s for w, x, c, s in zip(model.weights[1:], f, model.centre, model.scale))
        return 1 / (1 + math.exp(-z))

    some = docs[:25]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, l, model).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-9 for i, t, _ in some)
    assert len({round(got[i], 6) for i, *_ in some}) > 3


def test_a_window_met_again_is_not_compressed_again(learned, monkeypatch):
    *_, model = learned
    met, plain = [], toxicity._compressor

    def compressor(dictionary):
        lengths = plain(dictionary)
        return lambda windows: (met.extend(windows), lengths(windows))[1]

    monkeypatch.setattr(toxicity, "_compressor", compressor)
    monkeypatch.setattr(toxicity, "AT_ONCE", 2)
    cells = toxicity._Cells(model.ordinary, model.toxic)
    windows = toxicity._windows(b"one two three four five six one two three vrxglob and more last".split())
    assert windows == [b" one two three ", b" four five six ", b" one two three ", b" vrxglob and more ", b" last "]
    got = cells.of(windows)
    assert len(met) == 2 * 4 and got[0] == got[2]
    assert cells.of(windows[::-1]).tolist() == got[::-1].tolist() and len(met) == 2 * 4
    monkeypatch.setattr(toxicity, "KEPT_BYTES", 0)  # forgotten, and compressed again
    assert cells.of(windows).tolist() == got.tolist() and len(met) == 2 * 8
    assert [c.tolist() for _, c in cells.each(pa.array(["One two THREE", None, "", "last  one"]))] == [[got[0]], [], [], cells.of([b" last one "]).tolist()]
