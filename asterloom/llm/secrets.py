"""Secret scans: fixed patterns, and a linear-chain conditional random field over words.

The patterns' spans always stand.  The field tags every word as outside, begin
or inside of a secret from its shape, the words beside it, and what its file is
like.  It is trained on stretches of text around pattern matches and around the
longest and another word that no pattern matches, at most ``STRETCHES`` of each kind
(of a document the first ``PER_TEXT`` matches; of stretches up to ``LONGEST`` bytes).
The patterns' labels alone would teach it the patterns.  So their formats are
masked too: each stretch comes again with a key of another alphabet, length and
surroundings in place of its match, or put between ordinary words; and with
addresses, numbers, paths, rules and compound words, labelled as outside.
Decoding is Viterbi over whole texts: words that lie outside on any path,
whatever their neighbours are, are set apart first, which is exact, and the
stretches between them are decoded.  Its spans are added where they touch no
pattern span.

Defined results: a null text is empty and has no spans.  Positions are code
points, ends exclusive.  Rows that repeat a document are scanned each.  Without
a pattern match to train on the field adds nothing.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, written
from .text import Words, chunks, mix

#: The patterns' kinds in the order asked for, and what a match needs.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8

OUTSIDE, BEGIN, INSIDE = range(3)
#: Stretches of each kind that the field is trained on, those of one document, the words on each side of a match, and the longest stretch in bytes.
STRETCHES, PER_TEXT, AROUND, LONGEST = 1000, 4, 12, 4096
#: What keys that no pattern matches are made of, and what stands before and after them.
ALPHABETS = ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEF", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/")
SETTINGS = (("", ""), ("", ""), ('"', '"'), ("'", "',"), ("key=", ""), ("auth:", ""), ('"cred":"', '",'), ("<", ">"), ("", "."), ("sig=", ";"))
NEIGHBOURS = 512
#: Numbers of values of: shape, digits and changes, changes a byte by kinds of bytes, word before, word after, file.
FEATURES = (256, 36, 40, NEIGHBOURS, NEIGHBOURS, 16)
FIRST = np.cumsum((0, *FEATURES[:-1]))


def pattern_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def file_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0..15 for each text: how much of it is digits, and how much is '=', ':' or quotes."""

    def share(mask):
        sums = np.r_[0, np.cumsum(mask)]
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)

    digits = np.searchsorted([0.01, 0.05, 0.2], share((data >= 48) & (data <= 57)))
    marks = np.searchsorted([0.001, 0.01, 0.05], share(np.isin(data, np.frombuffer(b"=:\"'", np.uint8))))
    return digits * 4 + marks


def features(words: Words, file: np.ndarray) -> np.ndarray:
    """One column of feature numbers for each group of FEATURES."""
    data, s, e = words.data, words.start, words.end
    digit, upper, lower = (data >= 48) & (data <= 57), (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    kind = digit * 1 + upper * 2 + lower * 3
    within = lambda mask: np.r_[0, np.cumsum(mask)][e] - np.r_[0, np.cumsum(mask)][s]
    n_digit, n_upper, n_lower, length = within(digit), within(upper), within(lower), e - s
    change = np.r_[0, np.cumsum(np.r_[False, kind[1:] != kind[:-1]])]
    changes = change[e] - change[np.minimum(s + 1, e)]
    size = np.searchsorted([2, 4, 8, 12, 16, 20, 28, 36, 44, 60, 80, 100, 140, 200, 400], length)
    shape = size * 16 + (n_digit > 0) + 2 * (n_upper > 0) + 4 * (n_lower > 0) + 8 * (n_digit + n_upper + n_lower < length)
    texture = np.searchsorted([0.01, 0.2, 0.4, 0.7, 0.95], n_digit / length) * 6 + np.searchsorted([1, 3, 6, 12, 24], changes)
    mixed = np.searchsorted([0.1, 0.25, 0.4, 0.55], changes / length) * 8 + (n_digit > 0) + 2 * (n_upper > 0) + 4 * (n_lower > 0)
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    bucket = (mix(words.hash) % np.uint64(NEIGHBOURS - 1)).astype(np.int64) + 1  # 0: no such word
    before, after = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    if len(s):
        same = row[1:] == row[:-1]
        before[1:][same] = bucket[:-1][same]
        after[:-1][same] = bucket[1:][same]
    return np.stack([shape, texture, mixed, before, after, file[row]], 1) + FIRST


@dataclass
class Field:
    """Weights of features and of transitions for the three tags; ``moves[a, b]`` is from a to b."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = np.zeros((len(f), 3))
        for c in range(f.shape[1]):
            out += self.weights[f[:, c]]
        return out

    def decode(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi tags of all words; ``first`` bounds the texts.  Texts begin and end as if beside an outside word."""
        tags = np.zeros(len(emission), np.int8)
        if not len(emission):
            return tags
        m = self.moves
        # Where outside beats begin and inside by more than its neighbours can make up for, every best path is outside.
        # If the word ends a span, that is the gain of two transitions; if the span goes on, the next word would begin it.
        inner = [(p, x) for x in (BEGIN, INSIDE) for p in range(3) if m[p, x] > FORBIDDEN / 2]
        ends = max(m[p, x] + m[x, n] - m[p, OUTSIDE] - m[OUTSIDE, n] for p, x in inner for n in (OUTSIDE, BEGIN))
        goes_on = max(m[p, x] + m[x, INSIDE] - m[p, OUTSIDE] - m[OUTSIDE, BEGIN] for p, x in inner) + max(m[INSIDE, n] - m[BEGIN, n] for n in range(3))
        instead = np.r_[emission[1:, INSIDE] - emission[1:, BEGIN], -np.inf]
        open_ = emission[:, OUTSIDE] - emission[:, 1:].max(1) <= np.maximum(ends, goes_on + instead)
        new_text = np.zeros(len(emission) + 1, bool)
        new_text[first] = True
        start = np.flatnonzero(open_ & (new_text[:-1] | np.r_[True, ~open_[:-1]]))
        end = np.flatnonzero(open_ & (new_text[1:] | np.r_[~open_[1:], True])) + 1
        for n in np.unique(end - start):
            at = start[end - start == n]
            for low in range(0, len(at), 4096):
                tags[at[low : low + 4096, None] + np.arange(n)] = self._viterbi(emission[at[low : low + 4096, None] + np.arange(n)])
        return tags

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        """Tags of stretches (stretch, word, tag score) that lie between outside words."""
        best = e[:, 0] + self.moves[OUTSIDE]
        back = np.zeros(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            reach = best[:, :, None] + self.moves
            back[:, t] = reach.argmax(1)
            best = reach.max(1) + e[:, t]
        tags = np.zeros(e.shape[:2], np.int8)
        tags[:, -1] = (best + self.moves[:, OUTSIDE]).argmax(1)
        for t in range(e.shape[1] - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(len(e)), t, tags[:, t]]
        return tags


#: An inside word follows a begin or inside word only.
FORBIDDEN = -1e4


def train(sequences: list[tuple[np.ndarray, np.ndarray]], *, steps: int = 160, rate: float = 0.15, ridge: float = 2e-4) -> Field:
    """The field of greatest likelihood on (features, tags), by gradient steps over forward-backward marginals."""
    longest = max(len(t) for _, t in sequences)
    n = len(sequences)
    f = np.zeros((n, longest, len(FEATURES)), np.int64)
    y, live = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (a, b) in enumerate(sequences):
        f[i, : len(b)], y[i, : len(b)], live[i, : len(b)] = a, b, True
    w, m = np.zeros((sum(FEATURES), 3)), np.zeros((3, 3))
    allowed = np.zeros((3, 3))
    allowed[OUTSIDE, INSIDE] = FORBIDDEN
    mw, vw, mm, vm = np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)
    truth = np.eye(3)[y] * live[..., None]
    pair = np.zeros((3, 3))
    prior = np.concatenate([np.zeros((n, 1), np.int64), y[:, :-1]], 1)
    np.add.at(pair, (prior[live], y[live]), 1)
    places = [f[..., c][live] for c in range(len(FEATURES))]
    for step in range(1, steps + 1):
        e = w[f].sum(2)
        a = m + allowed
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        add = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
        alpha[:, 0] = e[:, 0] + a[OUTSIDE]
        for t in range(1, longest):
            alpha[:, t] = np.where(live[:, t, None], add(alpha[:, t - 1, :, None] + a, 1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], add(a + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        total = add(alpha[:, -1], 1)
        p = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
        gw = np.zeros_like(w)
        delta = (truth - p)[live]
        for c, at in enumerate(places):
            for tag in range(3):
                gw[:, tag] += np.bincount(at, delta[:, tag], len(gw))
        gm = pair.copy()
        gm[OUTSIDE] -= p[:, 0].sum(0)
        for t in range(1, longest):
            x = np.exp(alpha[:, t - 1, :, None] + a + (e[:, t] + beta[:, t])[:, None, :] - total[:, None, None])
            gm -= (x * live[:, t, None, None]).sum(0)
        for g, x, mo, ve in ((gw / n - ridge * w, w, mw, vw), (gm / n - ridge * m, m, mm, vm)):
            mo += 0.1 * (g - mo)
            ve += 0.01 * (g * g - ve)
            x += rate * (mo / (1 - 0.9**step)) / (np.sqrt(ve / (1 - 0.99**step)) + 1e-6)
    return Field(w, m + allowed)


def _tags(words: Words, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(len(words.start), np.int64)
    for s, _, e in spans:
        a, b = np.searchsorted(words.end, s, "right"), np.searchsorted(words.start, e, "left")
        tags[a:b] = INSIDE
        tags[a] = BEGIN
    return tags


def _key(rng: random.Random) -> bytes:
    before, after = rng.choice(SETTINGS)
    return f"{before}{''.join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(20, 64)))}{after}".encode()


def _decoy(rng: random.Random, words: list[bytes]) -> bytes:
    """A long word that is no secret."""
    some = lambda low, high: [rng.choice(words).strip(b".,;:!?").decode(errors="ignore") or "a" for _ in range(rng.randint(low, high))]
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    made = (
        lambda: "".join(some(2, 7)),
        lambda: "".join(w.capitalize() for w in some(2, 6)),
        lambda: rng.choice("_-/.|").join(some(3, 8)),
        lambda: "https://" + ".".join(some(2, 3)) + "/" + "/".join(some(1, 5)) + rng.choice(("", ".html", "?page=" + digits(2))),
        lambda: rng.choice("._-").join([*some(1, 2), digits(rng.randint(1, 3))]) + "@" + ".".join([some(1, 1)[0] + digits(rng.randint(0, 2)), *some(1, 1), "com"]),
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: digits(rng.randint(8, 24)),
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}Z",
        lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: "/" + "/".join(some(3, 6)) + rng.choice((".py", ".txt", digits(3) + ".log")),
        lambda: rng.choice("=-*#_.!aAxX0") * rng.randint(20, 80),
        lambda: rng.choice(some(1, 1)) * rng.randint(2, 12),
        lambda: rng.choice(some(1, 1)) + rng.choice("$#%&*!") * 3,
    )
    return rng.choice(made)().encode()


def _masked(words: list[bytes], tags: list[int], rng: random.Random) -> Iterator[tuple[list[bytes], list[int]]]:
    """The stretch with a key that no pattern matches, and with decoys."""
    outside = [w for w, t in zip(words, tags) if t == OUTSIDE] or [b"a"]
    decoyed = [_decoy(rng, outside) if t == OUTSIDE and rng.random() < 0.2 else w for w, t in zip(words, tags)]
    if rng.random() < 0.3:  # a line of one short word
        again = rng.choice([min((rng.choice(outside) for _ in range(4)), key=len), "óéßñ"[rng.randint(0, 3)].encode(), rng.choice("=-|.*:x0").encode()])
        low = rng.randint(0, len(words) - 1)
        decoyed = [again if t == OUTSIDE and low <= i < low + 12 else w for i, (w, t) in enumerate(zip(decoyed, tags))]
    yield decoyed, tags
    base = decoyed if rng.random() < 0.5 else words
    begin = [i for i, t in enumerate(tags) if t == BEGIN]
    if begin:
        at, to = begin[0], begin[0] + 1
        while to < len(tags) and tags[to] == INSIDE:
            to += 1
    else:
        at = to = rng.randint(0, len(words))
    yield [*base[:at], _key(rng), *base[to:]], [*tags[:at], BEGIN, *tags[to:]]


def _drawn(found: DataFrame) -> list:
    """At most STRETCHES stretches of each kind, by the order of their hashes."""
    rows = []
    for r in found.groupBy("kind").count().orderBy(F.desc("kind")).collect():  # two rows
        # About twice as many as are wanted pass a bound on the hash, whatever the number of partitions; the least of them are taken.
        bound = min(1.0, (2 * STRETCHES + 200) / r["count"])
        few = found.filter((F.col("kind") == r.kind) & (F.pmod("h", F.lit(1 << 40)) < int(bound * (1 << 40))))
        rows += few.orderBy(F.pmod("h", F.lit(1 << 40)), "part").limit(STRETCHES).collect()
    return rows


def fit(docs: DataFrame) -> Field | None:
    """Trains on stretches of ``docs`` (text), drawn by a hash over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for low, high, data, offsets in chunks(batch.column(0)):
                words, file = Words(data, offsets), file_features(data, offsets)
                whole = data.tobytes()
                for i in range(high - low):
                    a, b = words.first[i], words.first[i + 1]
                    if a == b:
                        continue
                    text = whole[offsets[i] : offsets[i + 1]]
                    spans = pattern_spans(text)
                    centre = [(1, np.searchsorted(words.start, offsets[i] + s, "right") - 1) for s, _, _ in spans[:PER_TEXT]]
                    size = words.end[a:b] - words.start[a:b]
                    size[_tags(words, [(s + offsets[i], k, e + offsets[i]) for s, k, e in spans])[a:b] > 0] = 0
                    centre += [(0, a + int(size.argmax())), (0, a + int(words.hash[a] ^ words.hash[b - 1]) % int(b - a))]
                    for kind, c in centre:
                        first, last = max(a, c - AROUND), min(b, c + AROUND + 1) - 1
                        part = whole[words.start[first] : words.end[last]]
                        if len(part) <= LONGEST and bool(pattern_spans(part)) == bool(kind):
                            out.append((kind, int(file[i]), part))
            out = out or []
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["kind", "file", "part"])

    found = docs.select("text").mapInArrow(run, "kind int, file int, part binary").withColumn("h", F.xxhash64("part"))
    with Scope():
        rows = _drawn(written(found, "secret-stretches"))
    if not any(r.kind for r in rows):
        return None
    sequences, seen, rng = [], set(), random.Random(29)
    for r in rows:
        part = bytes(r.part)
        if part in seen:
            continue
        seen.add(part)
        found = Words(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
        tags, file = _tags(found, pattern_spans(part)).tolist(), np.array([r.file])
        sequences.append((features(found, file), np.array(tags)))
        for words, their in _masked([part[x:y] for x, y in zip(found.start, found.end)], tags, rng):
            text = b" ".join(words)
            if len(pattern_spans(text)) <= sum(t == BEGIN for t in their):  # no decoy that is a pattern's match
                sequences.append((features(Words(np.frombuffer(text, np.uint8), np.array([0, len(text)])), file), np.array(their)))
    return train(sequences)


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", field: Field | None = None, redact: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_field of every row of ``docs``.

    With ``redact`` the columns of ``docs`` come instead, with that text in place of every span.
    """
    field = field or fit(docs)

    def scanned(texts: pa.Array) -> Iterator[tuple[list[int], str, str, int, str | None]]:
        for low, high, data, offsets in chunks(texts):
            words = Words(data, offsets)
            whole = data.tobytes()
            lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            tags = field.decode(field.emissions(features(words, file_features(data, offsets))), words.first) if field else np.zeros(len(words.start), np.int8)
            begin = np.flatnonzero((tags == BEGIN) | ((tags == INSIDE) & (np.r_[0, tags[:-1]] == OUTSIDE)))
            for i in range(high - low):
                at, to = int(offsets[i]), int(offsets[i + 1])
                base = [(s + at, k, e + at) for s, k, e in pattern_spans(whole[at:to])]
                taken = base[:]
                for b in begin[np.searchsorted(begin, words.first[i]) : np.searchsorted(begin, words.first[i + 1])]:
                    last = b
                    while last + 1 < words.first[i + 1] and tags[last + 1] == INSIDE:
                        last += 1
                    s, e = int(words.start[b]), int(words.end[last])
                    if not any(s < y and x < e for x, _, y in base):
                        taken.append((s, len(KINDS), e))
                named = lambda spans: ",".join(f"{(*KINDS, 'field')[k]}:{lead[s] - lead[at]}:{lead[e] - lead[at]}" for s, k, e in sorted(spans))
                clean = None
                if redact is not None:
                    parts, done = [], at
                    for s, _, e in sorted(taken):
                        if e > done:
                            if s >= done:
                                parts += [whole[done:s], redact.encode()]
                            done = e
                    clean = b"".join([*parts, whole[done:to]]).decode()
                yield [sum(k == j for _, k, _ in base) for j in range(3)], hashlib.sha256(named(base).encode()).hexdigest(), named(taken), len(taken) - len(base), clean

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(scanned(batch.column(1)))
            counts = [pa.array([r[0][j] for r in rows], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [r[4] for r in scanned(batch.column(at))]
            valid = batch.column(at).is_valid().to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([t if v else None for t, v in zip(texts, valid)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    if redact is not None:
        return docs.mapInArrow(clean, docs.schema)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, "text").mapInArrow(report, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_field long")
