"""N-gram Jaccard join by parity sketches: which documents' shingle sets have a Jaccard index of p/q or more.

Words are compared with A-Z in lower case.  A similar pair A, B (sizes a <= b) differs in at most d = (a + b)(q - p)/(q + p)
shingles, and b <= a q/p.  Per band of sizes the space of shingle hashes is cut
into K parts, more than the largest d of the band; a set's sketch holds, for
each part, the XOR of its shingles' 64-bit hashes there.  The number of unequal
parts - a Hamming distance between sketches - is at most the symmetric
difference, so by the pigeonhole principle a similar pair has an equal part.
A set is sketched for its own band, and for the band below if it is small enough
to have a partner there, so every similar pair meets in the band of its smaller
set.  Empty parts say nothing and are left out, unless a set has so few others
that the pigeonhole argument needs them.

Equal parts are found by one exchange of (part, set) entries packed per bucket.
Sets are named by a digest, so exact copies are one entry.  Groups of sets that
share a part are combined where they are read and again where they meet: a small
group gives all its pairs, a large one only the pairs of its smallest member
with the others.  Candidates are pruned by the Hamming distance of 1024-bit
parity sketches, which is a lower bound too, then verified on the whole texts.

What a large group could still hide are pairs in different components.  Such a
group is dealt with in a second round, without pairing its members:

* A set that has m filled parts shares m - d or more of them with a similar one
  (20 of 110, say, for 350 shingles).  So of the large groups that span
  components each set leaves the most frequent m - d - 1, and a set that is in
  fewer than m - d of them leaves all: sets that share no more than a passage.
* Its leader is the set that most such groups share, of its members and of those
  that share a group with one; every member left is compared with the leader.  Those linked to it are near, the others far.
* Two near members are in one component already.  For any other pair A, B let
  E be what a set and the leader differ in.  A and B differ in E(A) xor E(B), so
  if they link, E(A) and E(B) share at least (|E(A)| + |E(B)| - d) / 2 hashes,
  and this is 1 or more.  So, with the hashes of E in one order, they share
  a hash among the first few of either (prefix filter; how few depends on the
  sizes of both).  Hashes that the leader has not come first in that order.
* Hashes that one component alone has join nothing but fill these first places.
  So members that were changed at random meet nobody, however many they are.

Pairs that do meet are pruned and verified as before.  So no link between
components is lost, and groups of copies never give all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, partitions, written
from .components import components
from .packed import pack, unpack
from .text import U, Words, chunks, lowered, mix, shingles

#: Groups up to this number of sets give all pairs; it only moves work between the two rounds.
SMALL = 8
#: Entries that a task combines before it sends them on (16 bytes each).
FLUSH = 500_000
#: Shingles of the corpus for one bucket, so that a bucket fits into a task whatever the corpus' size.
PER_BUCKET = 2_000_000
SKETCH_WORDS = 16


class Bands:
    """Bands of set sizes with ratio 1.5, and the parts of each."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        high, low = [], 1
        while low < 1 << 40:
            high.append(max(low, math.ceil(low * 1.5) - 1))
            low = high[-1] + 1
        self.high = np.array(high)
        most = self.differ(self.high, self.high * q // p)
        self.parts = np.minimum((most + 1) * 27 // 25 + 3, (1 << 31) - 1)
        self.parts[most == 0] = 1

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most that sets of sizes a and b may differ in."""
        return (a + b) * (self.q - self.p) // (self.q + self.p)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, n)


def _per_row(values: np.ndarray, row: np.ndarray, n_rows: int, reduce: np.ufunc) -> np.ndarray:
    out = np.zeros(n_rows, values.dtype)
    if len(row):
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[at]] = reduce.reduceat(values, at)
    return out


def digests(row: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each row's set."""
    return tuple(_per_row(mix(h ^ U(salt)), row, n_rows, np.add).view(np.int64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def parity(row: np.ndarray, h: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """SKETCH_WORDS words of parity bits of each row's set."""
    word, bit = (h >> U(6)) % U(SKETCH_WORDS), U(1) << (h & U(63))
    return [_per_row(np.where(word == U(i), bit, U(0)), row, n_rows, np.bitwise_xor).view(np.int64) for i in range(SKETCH_WORDS)]


def least_shared(row: np.ndarray, h: np.ndarray, n: np.ndarray, bands: Bands) -> np.ndarray:
    """How many entries each row's set shares at least with any similar set; 1 or more."""
    least = np.full(len(n), 1 << 40)
    for band, wanted, partner in _homes(n, bands):
        part = ((h >> U(32)) * bands.parts[band][row].astype(U)) >> U(32)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
        shared = np.bincount(row[new], minlength=len(n)) - bands.differ(n, partner)
        least = np.where(wanted, np.minimum(least, shared), least)
    return np.maximum(least, 1)


def signatures(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """doc_id, n (size of the set), least (see ``least_shared``), two digests and the parity words of every row (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column(1)):
                row, h = shingles(Words(lowered(data), offsets), k)
                n = high - low
                size = np.bincount(row, minlength=n)
                cols = [size, least_shared(row, h, size, bands), *digests(row, h, n), *parity(row, h, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n).cast(pa.int64()), *map(pa.array, cols)], names)

    names = ["doc_id", "n", "least", "d1", "d2", *(f"s{i}" for i in range(SKETCH_WORDS))]
    return docs.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _homes(n: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(band, which sets are sketched for it, size of their largest partner there): the set's own band, and the one below."""
    own = bands.of(n)
    below = np.maximum(own - 1, 0)
    return [(own, n > 0, n * bands.q // bands.p), (below, (own > 0) & (n * bands.p <= bands.high[below] * bands.q), n)]


def _entries(row, h, owner, n, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, owner) of every part of every row's sketch."""
    h2 = mix(h + U(0x632BE59BD9B4E019))
    for band, wanted, partner in _homes(n, bands):
        rows = np.flatnonzero(wanted)
        if not len(rows):
            continue
        parts = bands.parts[band]
        use = wanted[row]
        r, x = row[use], h2[use]
        part = ((h[use] >> U(32)) * parts[r].astype(U)) >> U(32)  # rises with the hash, so rows stay sorted
        at = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (part[1:] != part[:-1])])
        label = lambda p, b: mix((p << U(8)) + b.astype(U) + U(1))
        yield mix(np.bitwise_xor.reduceat(x, at) ^ label(part[at], band[r[at]])), owner[r[at]]
        filled = np.bincount(r[at], minlength=len(n))
        for i in rows[filled[rows] <= bands.differ(n[rows], partner[rows])]:
            empty = np.setdiff1d(np.arange(parts[i], dtype=U), part[at][r[at] == i])
            yield mix(label(empty, np.full(len(empty), band[i]))), np.full(len(empty), owner[i])


def _grouped(key: np.ndarray, own: np.ndarray, large: np.ndarray):
    """Distinct (key, own) in order, starts and sizes of the groups of a key, and which groups are large."""
    order = np.lexsort((own, key))
    key, own, large = key[order], own[order], large[order]
    keep = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
    any_large = np.logical_or.reduceat(large, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]))
    key, own = key[keep], own[keep]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    return key, own, start, size, any_large | (size > SMALL)


def _stars(key, own, start, size, large) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, smallest member, other member) of the large groups."""
    member = np.repeat(large, size)
    lead = np.repeat(own[start], size)
    member[start] = False
    return key[member], lead[member], own[member]


def _all_pairs(own, start, size, large) -> tuple[np.ndarray, np.ndarray]:
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s in range(2, SMALL + 1):
        first = start[(size == s) & ~large]
        for i in range(s):
            for j in range(i + 1, s):
                a.append(own[first + i])
                b.append(own[first + j])
    return np.concatenate(a), np.concatenate(b)


_PACKED = "bucket long, c0 binary, c1 binary, c2 binary"


def _candidates(docs: DataFrame, k: int, bands: Bands, buckets: int) -> DataFrame:
    """(a, b, key) of digests: key is null for pairs of small groups, of which all are given."""

    def combined(key, own):
        key, own, start, size, large = _grouped(key, own, np.zeros(len(key), bool))
        x, lead, member = _stars(key, own, start, size, large)
        # Stars of this task need no other: they ride along, in buckets marked as negative.
        if len(x):
            yield pack(-1 - (x % U(buckets)).astype(np.int64), x, lead, member)
        send = ~np.repeat(large, size)
        send[start] = True
        key, own, flag = key[send], own[send], np.repeat(large, size)[send]
        yield pack((key % U(buckets)).astype(np.int64), key, own, flag)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, n_held = [], [], 0
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column(0)):
                row, h = shingles(Words(lowered(data), offsets), k)
                n = np.bincount(row, minlength=high - low)
                owner = digests(row, h, high - low)[0]
                for key, own in _entries(row, h, owner, n, bands):
                    keys.append(key)
                    owners.append(own)
                    n_held += len(key)
                if n_held >= FLUSH:
                    yield from combined(np.concatenate(keys), np.concatenate(owners))
                    keys, owners, n_held = [], [], 0
        if n_held:
            yield from combined(np.concatenate(keys), np.concatenate(owners))

    def meet(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            key, a, b = unpack(group, U, np.int64, np.int64)
            return _pairs(a, b, key)
        key, own, flag = unpack(group, U, np.int64, bool)
        key, own, start, size, large = _grouped(key, own, flag)
        x, lead, member = _stars(key, own, start, size, large)
        a, b = _all_pairs(own, start, size, large)
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        return pa.concat_tables([_pairs(pairs[:, 0], pairs[:, 1], None), _pairs(lead, member, x)])

    def _pairs(a, b, key) -> pa.Table:
        return pa.table({"a": pa.array(a), "b": pa.array(b), "key": pa.nulls(len(a), pa.int64()) if key is None else pa.array(key.view(np.int64))})

    return docs.select("text").mapInArrow(sketch, _PACKED).groupBy("bucket").applyInArrow(meet, "a long, b long, key long")


def _may_link(x: str, y: str, p: int, q: int) -> Column:
    """Sizes and parity sketches do not rule a link out."""
    c = F.col
    distance = sum((F.bit_count(c(f"{x}.s{i}").bitwiseXOR(c(f"{y}.s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    sizes = (c(f"{x}.n") * q >= c(f"{y}.n") * p) & (c(f"{y}.n") * q >= c(f"{x}.n") * p)
    return sizes & (distance * (q + p) <= (c(f"{x}.n") + c(f"{y}.n")) * (q - p))


def _compared(pairs: DataFrame, docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """Pairs (a, b: structs with rep and d1) by their whole texts' sets: ids and digests, sizes, linked, how many hashes differ, and the first of these.

    The order is: hashes that b has and a has not, then those that a has and b has not, each by number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                n = part.num_rows
                sets = [shingles_of(part.column(i), n) for i in (4, 5)]
                known, sizes, linked, first = [], [], [], []
                for i in range(n):
                    (x, xd), (y, yd) = (s[i] for s in sets)
                    known.append(xd == part.column(1)[i].as_py() and yd == part.column(3)[i].as_py())
                    more, less = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                    both, apart = len(y) - len(more), len(more) + len(less)
                    sizes.append((len(x), len(y), apart))
                    linked.append(q * both >= p * (both + apart))
                    first.append(np.r_[more, less][: len(y) * (q - p) // p + 1].view(np.int64))
                size = np.array(sizes, np.int64).reshape(-1, 3)
                out = [*part.columns[:4], *(pa.array(size[:, i].copy()) for i in range(3)), pa.array(linked, pa.bool_()), pa.array(first, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, ["a", "ad", "b", "bd", "an", "bn", "apart", "linked", "first"]).filter(pa.array(known, pa.bool_()))

    def shingles_of(texts: pa.Array, n: int) -> list[tuple[np.ndarray, int]]:
        out = []
        for low, high, data, offsets in chunks(texts):
            row, h = shingles(Words(lowered(data), offsets), k)
            d = digests(row, h, high - low)[0]
            cut = np.searchsorted(row, np.arange(high - low + 1))
            out += [(h[cut[i] : cut[i + 1]], int(d[i])) for i in range(high - low)]
        return out

    texts = docs.select("doc_id", "text")
    flat = pairs.select(F.col("a.rep").alias("a"), F.col("a.d1").alias("ad"), F.col("b.rep").alias("b"), F.col("b.d1").alias("bd"))
    second = flat.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    first = second.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    return first.select("a", "ad", "b", "bd", "a_text", "b_text").mapInArrow(run, "a long, ad long, b long, bd long, an long, bn long, apart long, linked boolean, first array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b: structs with rep and d1) whose whole texts' sets are similar, as document ids."""
    return _compared(pairs, docs, k, p, q).filter("linked").select("a", "b").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, in) after ``links`` (a, b) between reps, which only join components."""
    ends = links.join(labels.select(F.col("rep").alias("a"), F.col("in").alias("x")), "a").join(labels.select(F.col("rep").alias("b"), F.col("in").alias("y")), "b")
    joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return labels.join(joined.withColumnRenamed("node", "in"), "in", "left").select("rep", F.coalesce("component", "in").alias("in"))


def _spread(members: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """members (by, rep, ...) of the groups that lie in several components, with the component as ``in``."""
    placed = members.join(labels, "rep")
    several = placed.groupBy(by).agg(F.min("in").alias("x"), F.max("in").alias("y")).filter("x != y").select(by)
    return placed.join(several, by)


def _rarest(members: DataFrame) -> DataFrame:
    """members (key, rep, least, size) without the keys of each rep's ``least`` - 1 largest groups.

    The order of groups must stay the same from call to call: then fewer groups leave fewer of the same members.
    """
    by = Window.partitionBy("rep")  # a set is in as many groups as it has parts
    placed = members.withColumn("place", F.row_number().over(by.orderBy("size", "key"))).withColumn("of", F.count("*").over(by))
    return placed.filter("place <= of - least + 1").select("key", "rep")


def _meetings(far: DataFrame, p: int, q: int, buckets: int) -> DataFrame:
    """(a, b) of rep: members of a leader's group that a prefix of their differences brings together.

    ``far`` (leader, ld, leader_n, rep, n, apart, linked, in, first, fold) has the members of the groups that lie in several components;
    ``fold`` are the 256 bits of a set's parity sketch folded, whose distance is a lower bound too and prunes where members meet.
    """
    e, n = F.col("apart"), F.col("n")
    # A partner's E has lo to hi hashes: it differs from the member in d at most, and a far one differs from the leader in more than a link may.
    d = F.floor(n * (q - p) / p)
    link = lambda size: F.floor((size + F.col("leader_n")) * (q - p) / (q + p))
    far_lo, far_hi = F.greatest(e - d, link(F.floor(n * p / q)) + 1), e + d
    near_lo, near_hi = F.greatest(e - d, F.lit(0)), F.least(e + d, link(F.ceil(n * q / p)))
    first = lambda least: e - F.greatest(F.ceil((e + least - d) / 2), F.lit(1)) + 1
    useful = F.greatest(F.when(far_lo <= far_hi, first(far_lo)), F.when(~F.col("linked") & (near_lo <= near_hi), first(near_lo)))
    useful = F.slice("first", F.lit(1), F.coalesce(useful, F.lit(0)).cast("int"))
    members = far.select(F.xxhash64("leader", "ld", "rep").alias("member"), F.xxhash64("leader", "ld").alias("group"), "in", useful.alias("xs"), F.struct("rep", "in", "n", "apart", "linked", "fold").alias("m"))
    members = written(members, "jaccard-far")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            member, group, place, xs = (batch.column(c) for c in range(4))
            size = xs.value_lengths().to_numpy()
            many = lambda c, kind: np.repeat(c.to_numpy().view(kind), size)
            key = mix(mix(many(group, U)) ^ xs.flatten().to_numpy().view(U))  # equal by chance: more pairs to verify
            if len(key):
                at = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
                yield pack((key % U(buckets)).astype(np.int64), key, many(member, np.int64), many(place, np.int64), at.astype(np.int32))

    def shared(bucket: pa.Table) -> pa.Table:
        """The entries whose key is in several components."""
        key, member, place, at = unpack(bucket, U, np.int64, np.int64, np.int32)
        order = np.lexsort((place, key))
        key, member, place, at = key[order], member[order], place[order], at[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        keep = np.repeat(place[start] != place[start + size - 1], size)
        return pa.table({"x": pa.array(key[keep].view(np.int64)), "member": pa.array(member[keep]), "at": pa.array(at[keep].astype(np.int64))})

    packed = members.select("member", "group", "in", "xs").mapInArrow(entries, _PACKED + ", c3 binary")
    found = packed.groupBy("bucket").applyInArrow(shared, "x long, member long, at long")
    rows = written(found.join(members.select("member", "m"), "member").select("x", F.struct("m.*", "at").alias("m")), "jaccard-shared")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    least = F.ceil((x("apart") + y("apart") - F.floor((x("n") + y("n")) * (q - p) / (q + p))) / 2)  # hashes of E that a pair that links shares
    placed = (x("at") <= x("apart") - F.greatest(least, F.lit(1))) & (y("at") <= y("apart") - F.greatest(least, F.lit(1)))
    distance = sum((F.bit_count(x("fold")[i].bitwiseXOR(y("fold")[i])) for i in range(4)), F.lit(0))
    may = (x("in") < y("in")) & ~(x("linked") & y("linked")) & placed & (distance * (q + p) <= (x("n") + y("n")) * (q - p))
    met = rows.withColumnRenamed("m", "a").join(rows.withColumnRenamed("m", "b"), "x").filter(may)
    return met.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()


def similar_documents(docs: DataFrame, *, k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text): components of links of Jaccard index p/q or more.

    Defined results: a null or empty text, or one without words, has an empty set
    and links with nothing; fewer words than ``k`` count as one shingle.  Rows
    that repeat a document are rows of the result; ids that repeat with other
    texts are one node.  A row without an id counts with the rows that have its
    set, and by itself links with nothing.  An empty table gives an empty result;
    other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scope() as scope:
        bands = Bands(p, q)
        signed = scope.keep(written(signatures(docs, k, bands), "jaccard-sets"))
        sketch = [f"s{i}" for i in range(SKETCH_WORDS)]
        classes = written(signed.filter("n > 0").groupBy("d1", "d2", "n", "least", *sketch).agg(F.min("doc_id").alias("rep")), "jaccard-classes")
        hashes = signed.agg(F.sum("n")).first()[0] or 0
        buckets = max(4 * partitions(docs.sparkSession), hashes // PER_BUCKET)
        found = written(_candidates(docs, k, bands, buckets), "jaccard-candidates")

        known = F.struct("rep", "d1", "n", *sketch)
        as_node = lambda name: classes.select(F.col("d1").alias(name), known.alias(f"{name}_set"))
        pairs = found.select("a", "b").distinct().join(as_node("a"), "a").join(as_node("b"), "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
        links = written(_verified(pairs.filter(_may_link("a", "b", p, q)), docs, k, p, q), "jaccard-links")
        grouped = components(links)
        labels = classes.select("rep").distinct().join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("in"))

        # The second round: large groups whose members are in several components.
        stars = found.filter("key is not null")
        members = stars.select("key", F.col("a").alias("d1")).unionByName(stars.select("key", F.col("b").alias("d1"))).distinct()
        members = members.join(classes.select("d1", "rep", "least"), "d1").groupBy("key", "rep").agg(F.min("least").alias("least"))
        sizes = members.groupBy("key").agg(F.count("*").alias("size"))
        members = written(_spread(members, labels, "key").join(sizes, "key").select("key", "rep", "least", "size"), "jaccard-spread")
        rare = lambda: _spread(_rarest(_spread(members, labels, "key")), labels, "key").select("key", "rep")
        if not members.isEmpty():
            best = lambda side, by: side.groupBy(by).agg(F.min("best").alias("best"))
            shared = members.groupBy("rep").agg(F.count("*").alias("groups")).select("rep", F.struct(-F.col("groups"), F.col("rep").alias("leader")).alias("best"))
            leaders = best(members.join(best(members.join(best(members.join(shared, "rep"), "key"), "key"), "rep"), "rep"), "key")
            leaders = written(leaders.select("key", "best.leader"), "jaccard-leaders")
            under = lambda members: members.join(leaders, "key").select("leader", "rep").filter("leader != rep").distinct()
            of = lambda name, rep: classes.select(F.col("rep").alias(rep), F.struct("rep", "d1", "n").alias(name))
            pairs = under(rare()).join(of("a", "leader"), "leader").join(of("b", "rep"), "rep").select("a", "b")
            led = written(_compared(pairs, docs, k, p, q).dropDuplicates(["a", "ad", "b", "bd"]), "jaccard-led")
            labels = written(_merged(labels, led.filter("linked").select("a", "b")), "jaccard-labels")
            names = {"leader": "a", "ld": "ad", "leader_n": "an", "rep": "b", "bd": "bd", "n": "bn"}
            far = _spread(led.select(*(F.col(v).alias(k) for k, v in names.items()), "apart", "linked", "first"), labels, "leader")
            far = far.join(under(rare()), ["leader", "rep"], "left_semi")  # fewer: many groups lie in one component by now
            xor = lambda i: F.col(f"s{i}").bitwiseXOR(F.col(f"s{i + 4}")).bitwiseXOR(F.col(f"s{i + 8}")).bitwiseXOR(F.col(f"s{i + 12}"))
            folds = classes.select(F.col("rep"), F.col("d1").alias("bd"), F.array(*map(xor, range(4))).alias("fold"))
            met = _meetings(far.join(folds, ["rep", "bd"]), p, q, buckets)
            whole = lambda name: classes.select(F.col("rep").alias(name), known.alias(f"{name}_set"))
            missed = met.join(whole("a"), "a").join(whole("b"), "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
            more = written(_verified(missed.filter(_may_link("a", "b", p, q)), docs, k, p, q), "jaccard-more")
            if not more.isEmpty():
                labels = _merged(labels, more)
        answer = classes.select("d1", "d2", "n", "rep").join(labels, "rep", "left").select("d1", "d2", "n", F.col("in").alias("component_id"))
        answer = scope.keep(written(answer, "jaccard-answer"))
    done = signed.join(answer, ["d1", "d2", "n"], "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
