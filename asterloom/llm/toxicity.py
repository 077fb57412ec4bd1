"""Toxicity by compression distance between two zstandard dictionaries, of which one is trained.

A window is three words.  It is compressed with a dictionary trained on ordinary
text, and with one that also knows toxic text: the ordinary dictionary followed
by the words, and beginnings of words, that mark labelled toxic documents.  No
dictionary is trained on toxic text (the README has figures of that), so phrases
of words that are ordinary one by one, and words in less than ``LEAST_SHARE`` of
the toxic rows, are not found.  The pair of lengths is a
cell of a small table; cells are calibrated to log odds on labelled documents,
and a document's score is a logistic function of its windows' largest and
summed log odds.  Everything is fitted on labelled rows only, at most ``TOXIC_ROWS`` and
``ORDINARY_ROWS`` of them (drawn by a hash of the id), and held-out rows are not
among them.  Copies among these count once.  Every document is scored on its
whole text; labels, language, source and id play no part in a score.

Defined results: null and empty texts have no windows and get the score of a
document in which nothing is found.  Without labelled rows of both kinds every
score is the share of toxic ones (0 if there is none at all).  Rows that repeat
a document are scored each; repeated labels count as toxic if one of them does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scope, ascii_lower, written
from .text import WORD_BASE, Words, between, chunks, lowered, prefix

WINDOW = 3
TOXIC_ROWS, ORDINARY_ROWS = 2000, 6000
MARKING_UNITS = 1024
#: Beginnings of words of these lengths are units too, so that inflected forms are known from few rows.
BEGINNINGS = (4, 5, 6)
ORDINARY_WINDOWS = 8000
DICTIONARY_BYTES = 32768
#: Lengths are told apart up to this; longer windows are compared by what the toxic dictionary saves.
SIDE = 48
#: A word marks toxic text at this log-likelihood ratio, this many times the ordinary share, and this share of toxic rows.
LEAST_RATIO, LEAST_TIMES, LEAST_SHARE = 10.5, 20.0, 0.015
#: Log odds below this are noise when they are summed.
NOISE = 0.7
THRESHOLD = 0.3
#: Windows that are compressed by one dictionary before the other one's turn, and bytes of windows whose cells are remembered, about.
TOGETHER, KEPT_BYTES = 10_000, 64 << 20
#: Windows a call of the compressor.
AT_ONCE = 5000
_NUMBERS = list(range(SIDE * SIDE))


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    log_odds: np.ndarray = field(default_factory=lambda: np.zeros(SIDE * SIDE))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(3))
    scale: np.ndarray = field(default_factory=lambda: np.ones(3))
    constant: float | None = None

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        z = np.c_[np.ones(len(features)), (features - self.centre) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _compressor(dictionary: bytes) -> Callable[[list[bytes]], np.ndarray]:
    """Gives the length of each of some windows, compressed by itself."""
    params = zs.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=17, search_log=5, min_match=3, target_length=32, strategy=zs.STRATEGY_BTOPT,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    known = zs.ZstdCompressionDict(dictionary)
    known.precompute_compress(compression_params=params)
    many = zs.ZstdCompressor(dict_data=known, compression_params=params).multi_compress_to_buffer

    def lengths(windows: list[bytes]) -> np.ndarray:
        out = np.empty(len(windows), np.int64)
        for low in range(0, len(windows), AT_ONCE):
            some = many(windows[low : low + AT_ONCE], threads=1)
            out[low : low + len(some)] = [len(some[i]) for i in range(len(some))]
        return out

    return lengths


def _windows(w: list[bytes]) -> list[bytes]:
    whole = len(w) // WINDOW * WINDOW
    found = [b" ".join((b"", *x, b"")) for x in zip(*(w[i:whole:WINDOW] for i in range(WINDOW)))]
    return found + [b" ".join((b"", *w[whole:], b""))] if whole < len(w) else found


def _normal(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(row, windows) of every text: words in lower case (A-Z), one space between."""
    for low, high, data, offsets in chunks(texts):
        data = lowered(data)
        whole = data.tobytes()
        for i in range(high - low):
            yield low + i, _windows(whole[offsets[i] : offsets[i + 1]].split())


class _Cells:
    """The cells of windows.  A window is compressed once for as long as it is remembered: ``KEPT_BYTES`` of them, then all are forgotten."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)
        self.known: dict[bytes, int] = {}
        self.size = 0

    def of(self, windows: list[bytes]) -> np.ndarray:
        if self.size > KEPT_BYTES:
            self.known, self.size = {}, 0
        known = self.known
        new = [w for w in dict.fromkeys(windows) if w not in known]
        # One dictionary after the other, so each stays in the processor's cache.
        a, b = self.ordinary(new), self.toxic(new)
        over = np.maximum(np.maximum(a, b) - (SIDE - 1), 0)
        a, b = np.maximum(a - over, 0), np.maximum(b - over, 0)
        known.update(zip(new, map(_NUMBERS.__getitem__, (a * SIDE + b).tolist())))
        self.size += sum(map(len, new)) + 150 * len(new)
        return np.fromiter(map(known.__getitem__, windows), np.int32, len(windows))

    def each(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, cells) of every text, some texts at a time."""
        held: list[tuple[int, list[bytes]]] = []
        n = 0
        for row, windows in _normal(texts):
            held.append((row, windows))
            n += len(windows)
            if n >= TOGETHER:
                yield from self._each(held)
                held, n = [], 0
        yield from self._each(held)

    def _each(self, held: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, np.ndarray]]:
        cells, at = self.of([w for _, windows in held for w in windows]), 0
        for row, windows in held:
            yield row, cells[at : at + len(windows)]
            at += len(windows)


def _features(cells: np.ndarray, log_odds: np.ndarray) -> tuple[float, float, float]:
    if not len(cells):
        return 0.0, 0.0, 0.0
    w = log_odds[cells]
    total = np.maximum(w - NOISE, 0).sum()
    return float(max(w.max(), 0)), float(total / np.sqrt(len(w))), float(np.log1p(total))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled rows that are fitted on; of copies (by the least hash of their 6-word sequences) one each."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda kind, n: known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, TOXIC_ROWS).unionByName(pick(0, ORDINARY_ROWS))  # at most 8000 short rows
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for low, high, data, offsets in chunks(batch.column(1)):
                w = Words(lowered(data), offsets)
                for i in range(high - low):
                    a, b = w.first[i], w.first[i + 1]
                    if a < b:
                        at = np.arange(a, max(a + 1, b - 5))
                        out[low + i] = between(prefix(w.hash, WORD_BASE), at, np.minimum(at + 6, b)).min()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], [*batch.schema.names, "least"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(rows.mapInArrow(least, f"doc_id {kind}, text string, toxic {chosen.schema['toxic'].dataType.simpleString()}, least long"), "toxicity-rows")
    first = signed.groupBy("least").agg(F.min("doc_id").alias("doc_id"))
    return written(signed.join(F.broadcast(first), ["least", "doc_id"], "left_semi").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "toxicity-sample")


def _marking_units(sample: DataFrame, n1: int, n0: int) -> list[str]:
    plain = F.transform(F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: F.regexp_replace(x, r"^\p{Punct}+|\p{Punct}+$", ""))
    plain = F.filter(F.array_distinct(plain), lambda x: F.length(x).between(3, 64))
    units = [F.transform(plain, lambda x: F.concat(F.lit(" "), x, F.lit(" ")))]
    units += [F.transform(F.filter(plain, lambda x, n=n: F.length(x) > n), lambda x, n=n: F.concat(F.lit(" "), F.substring(x, 1, n))) for n in BEGINNINGS]
    each = sample.select("toxic", F.explode(F.array_distinct(F.concat(*units))).alias("w"))
    by = each.groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    n, part = n1 + n0, lambda k, m, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < m, (m - k) * F.log(1 - p)).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    ratio = 2 * (part(a, n1, a / n1) + part(b, n0, b / n0) - part(a, n1, (a + b) / n) - part(b, n0, (a + b) / n))
    good = (F.col("a") >= max(2, LEAST_SHARE * n1)) & (a / n1 >= LEAST_TIMES * (b + 0.5) / n0) & (ratio >= LEAST_RATIO)
    best = by.filter(good).select("w", ratio.alias("ratio")).orderBy(ratio.desc(), F.length("w").desc(), "w").limit(MARKING_UNITS).collect()
    # A unit says nothing new if it begins like one that marks more rows, or is the beginning of one that marks as many.
    chosen: list[str] = []
    for r in best:
        if not any(r.w.startswith(c) or c.startswith(r.w) for c in chosen):
            chosen.append(r.w)
    return chosen


def _ordinary_windows(sample: DataFrame) -> list[bytes]:
    each = 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for _, w in _normal(batch.column(0)) for x in w[:: max(1, -(-len(w) // each))]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["w"])

    rows = sample.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ORDINARY_WINDOWS // each).select("text")
    return [bytes(r.w) for r in rows.mapInArrow(run, "w binary").collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    with Scope():
        return _fitted(_sample(docs, labels))


def _fitted(sample: DataFrame) -> Model:
    count = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = count.get(1, 0), count.get(0, 0)
    if not n1 or not n0:
        return Model(constant=float(n1 > 0))
    windows = sorted(_ordinary_windows(sample))
    np.random.default_rng(5).shuffle(windows)
    try:
        ordinary = zs.train_dictionary(DICTIONARY_BYTES, windows).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself
        ordinary = b"".join(windows)[-DICTIONARY_BYTES:] + b" " * 8
    words = _marking_units(sample, n1, n0)
    toxic = ordinary + b"".join(w.encode() for w in reversed(words)) + b" "

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measured = _Cells(ordinary, toxic)
        for batch in batches:
            found = [c for _, c in measured.each(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["toxic", "cells"])

    rows = written(sample.select("text", "toxic").mapInArrow(cells, "toxic int, cells array<int>"), "toxicity-cells")
    seen = np.zeros((2, SIDE * SIDE))
    for r in rows.select("toxic", F.explode(F.array_distinct("cells")).alias("cell")).groupBy("toxic", "cell").count().collect():  # 4608 rows at most
        seen[r.toxic, r.cell] = r["count"]
    model = Model(ordinary, toxic, np.log((seen[1] + 0.02) / (n1 + 0.04)) - np.log((seen[0] + 0.2) / (n0 + 0.4)))
    model.log_odds[(seen[0] + seen[1]) < 2] = 0

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            f = np.array([_features(flat[x:y], model.log_odds) for x, y in zip(offsets[:-1], offsets[1:])]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[:, i].copy()) for i in range(3))], ["toxic", "f0", "f1", "f2"])

    rows = rows.mapInArrow(features, "toxic int, f0 double, f1 double, f2 double").collect()  # at most 8000 short rows
    x, y = np.array([[r.f0, r.f1, r.f2] for r in rows]), np.array([r.toxic for r in rows], float)
    model.centre, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.weights = _logistic((x - model.centre) / model.scale, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _scores(texts: pa.Array, cells: _Cells | None, model: Model) -> tuple[np.ndarray, np.ndarray]:
    f = np.zeros((len(texts), 3))
    if cells:
        for i, c in cells.each(texts):
            f[i] = _features(c, model.log_odds)
    return model.score(f), f


def _measured(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and features of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(model.ordinary, model.toxic) if model.constant is None else None
        for batch in batches:
            score, f = _scores(batch.column(1), cells, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *(pa.array(f[:, i].copy()) for i in range(3))], names)

    names = ["doc_id", "score", "f0", "f1", "f2"]
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, f0 double, f1 double, f2 double")


def score_toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), as ``labels`` (doc_id, toxic) marks toxic ones."""
    model = model or fit(docs, labels)
    scored = _measured(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns, in one pass over the texts."""
    model = model or fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(model.ordinary, model.toxic) if model.constant is None else None
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), cells, model)[0] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
