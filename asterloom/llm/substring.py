"""Substring dedup over a log-structured fingerprint index.

A window is ``window`` consecutive words.  Of the hashes of all ``gram``-word
sequences in a window the smallest is its fingerprint, so equal windows have the
same fingerprint wherever they stand, and about one word in thirteen starts one.
``FingerprintIndex`` keeps sorted immutable runs of historical fingerprints in a
folder that can be opened again.  A new batch of documents is counted by
fingerprint and merge-joined with each run, which are dealt into buckets alike,
so that history is not exchanged; fingerprints met again are noted, the batch becomes
a run, and runs are merged into one when they are many.  The windows whose fingerprint was noted are hashed
whole (64 bits over all their words, by another base than the fingerprint's) and
verified against each other.  Then every word that a repeated window covers is
removed.  Two hashes of 64 bits hold a third more on disk than the check's budget
allows; with one, of n suspect windows about n * n / 2**65 pairs meet by chance.

Entries are combined where they are read: a window that repeats there is known
to be repeated and sends one entry, so a passage that a third of all documents
share costs an entry a task, not one a document.

Defined results: a null or empty text has no words, keeps the empty text and
removes nothing.  Rows that repeat a document are copies of each other.  Texts
shorter than a window keep all their words.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, scratch_root
from .packed import pack, unpack
from .text import ALT_BASE, U, WORD_BASE, Words, between, chunks, prefix

WINDOW = 35
GRAM = 10
#: Runs that are kept side by side before they are merged.
FANOUT = 2
#: Window entries that a task combines before it sends them on (21 bytes each, 12 if it has met them before).
FLUSH = 1_000_000


def _anchored(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its row, its first word, its fingerprint's word, and the fingerprint."""
    empty = np.empty(0, np.int64)
    if len(words.hash) < window:
        return empty, empty, empty, empty.view(U)
    at = np.arange(len(words.hash) - gram + 1)
    grams = between(prefix(words.hash, WORD_BASE), at, at + gram)
    width = window - gram + 1
    n = len(grams) - width + 1
    # The leftmost minimum of each run of ``width`` hashes, by doubling.
    best = at
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    first = np.flatnonzero(row[:n] == row[window - 1 : window - 1 + n])
    anchor = best[first]
    return row[first], first, anchor, grams[anchor]


def _distinct_anchors(row, first, anchor, print_) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) once for each place that a fingerprint stands at."""
    if not len(first):
        return row, print_
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
    return row[new], print_[new]


class FingerprintIndex:
    """Sorted immutable runs (fp, n: 1, or 2 for more) in a folder, and notes (fp) of what was met again.

    A run's folder is named by the first and the last batch in it, so a merged
    run tells which runs it replaces, also if these were not yet deleted.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, window: int = WINDOW, gram: int = GRAM):
        self.spark, self.window, self.gram = spark, window, gram
        self.path = path or f"{scratch_root(spark)}/fingerprints-{uuid.uuid4().hex}"

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> FingerprintIndex:
        """The index that is kept in ``path``."""
        return cls(spark, path, **options)

    def _folders(self, kind: str) -> list[tuple[int, int, int]]:
        """(first batch, last batch, buckets) of the folders of a kind that no other replaces."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        store = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath() for f in store.listStatus(path)] if store.exists(path) else []
        whole = [n for n in names if n.getName().startswith(kind + "-") and store.exists(n.suffix("/_SUCCESS"))]
        found = [tuple(map(int, n.getName().split("-")[1:])) for n in whole]
        return sorted(x for x in found if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in found))

    def _table(self, kind: str, of: tuple[int, int, int]) -> DataFrame:
        """A run or note as a bucketed table, whose scan says how it is dealt."""
        path, columns = f"{self.path}/{kind}-{'-'.join(map(str, of))}", "fp BIGINT, n INT" if kind == "run" else "fp BIGINT"
        name = "fingerprints_" + hashlib.md5(path.encode()).hexdigest()
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {of[2]} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, kind: str, of: tuple[int, int, int]) -> None:
        path = f"{self.path}/{kind}-{'-'.join(map(str, of))}"
        name = "fingerprints_" + hashlib.md5(path.encode()).hexdigest()
        rows.write.format("parquet").bucketBy(of[2], "fp").sortBy("fp").option("path", path).mode("overwrite").saveAsTable(name)

    def _drop(self, kind: str, of: tuple[int, int, int]) -> None:
        path = f"{self.path}/{kind}-{'-'.join(map(str, of))}"
        self.spark.sql(f"DROP TABLE IF EXISTS fingerprints_{hashlib.md5(path.encode()).hexdigest()}")
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def runs(self) -> list[tuple[int, int, int]]:
        return self._folders("run")

    def ingest(self, docs: DataFrame) -> None:
        """Joins the fingerprints of the documents (text) with the runs, notes those met again, and adds a run; merges the runs if there are more than FANOUT."""
        old = self.runs()
        buckets = old[0][2] if old else partitions(self.spark)
        of = (old[-1][1] + 1 if old else 0,) * 2 + (buckets,)
        total = F.least(F.sum("n"), F.lit(2)).cast("int").alias("n")
        self._write(self._counts(docs).repartition(buckets, "fp").groupBy("fp").agg(total), "run", of)
        new = self._table("run", of)
        again = new.filter("n > 1").select("fp")
        for run in old:
            again = again.unionByName(new.join(self._table("run", run), "fp", "left_semi").select("fp"))
        self._write(again.distinct(), "again", of)
        if len(old) + 1 > FANOUT:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one."""
        old = self.runs()
        if len(old) > 1:
            merged = self._table("run", old[0])
            for run in old[1:]:
                merged = merged.unionByName(self._table("run", run))
            of = (old[0][0], old[-1][1], old[0][2])
            self._write(merged.repartition(of[2], "fp").groupBy("fp").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n")), "run", of)
            for run in old:
                self._drop("run", run)

    def repeated(self) -> DataFrame:
        """The fingerprints that were seen more than once, in a batch or in several."""
        notes = [self._table("again", of) for of in self._folders("again")]
        found = notes[0] if notes else self.spark.createDataFrame([], "fp long")
        for note in notes[1:]:
            found = found.unionByName(note)
        return found.distinct()

    def drop(self) -> None:
        """Deletes the index."""
        for kind in ("run", "again"):
            for of in self._folders(kind):
                self._drop(kind, of)

    def probe(self, docs: DataFrame) -> DataFrame:
        """(key, fps): for documents (key, text), their fingerprints that were seen more than once."""
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, data, offsets in chunks(batch.column(1)):
                    row, fp = _distinct_anchors(*_anchored(Words(data, offsets), window, gram))
                    order = np.lexsort((fp, row))
                    row, fp = row[order], fp[order]
                    new = np.r_[True, (row[1:] != row[:-1]) | (fp[1:] != fp[:-1])][: len(row)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new] + low)), pa.array(fp[new].view(np.int64))], ["key", "fp"])

        seen = docs.select("key", "text").mapInArrow(run, "key long, fp long")
        return seen.join(self.repeated(), "fp").groupBy("key").agg(F.collect_set("fp").alias("fps"))

    def _counts(self, docs: DataFrame) -> DataFrame:
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = [_distinct_anchors(*_anchored(Words(data, offsets), window, gram))[1] for _, _, data, offsets in chunks(batch.column(0))]
                if held:
                    fp, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["fp", "n"])

        return docs.select("text").mapInArrow(run, "fp long, n int")


def _repeated_windows(suspects: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, starts): the first words of the windows of suspects (key, fps, text) that stand elsewhere too."""
    buckets = 2 * partitions(suspects.sparkSession)

    def combined(h, key, at):
        order = np.lexsort((at, key, h))
        h, key, at = h[order], key[order], at[order]
        lead = np.r_[True, h[1:] != h[:-1]]
        many = np.diff(np.r_[np.flatnonzero(lead), len(h)]) > 1
        known = np.repeat(many, np.diff(np.r_[np.flatnonzero(lead), len(h)]))
        rest = known & ~lead
        if rest.any():  # repeated here already: straight to their documents
            yield sent(-1 - (key[rest].view(U) % U(buckets)).astype(np.int64), key[rest], at[rest])
        h, key, at, known = h[lead], key[lead], at[lead], known[lead]
        order = np.lexsort((at, key))
        yield sent((h[order] % U(buckets)).astype(np.int64), key[order], at[order], h[order], known[order])

    def sent(bucket, *columns) -> pa.RecordBatch:
        """Four columns; those that are not given are empty."""
        batch = pack(bucket, *columns)
        empty = pa.array([b""] * batch.num_rows, pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, *[empty] * (4 - len(columns))], ["bucket", *(f"c{i}" for i in range(4))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            prints, text = batch.column(1), batch.column(2)
            for low, high, data, offsets in chunks(text):
                words = Words(data, offsets)
                row, first, _, fp = _anchored(words, window, gram)
                cut = np.searchsorted(row, np.arange(high - low + 1))
                keep = np.zeros(len(row), bool)
                for i in range(high - low):
                    keep[cut[i] : cut[i + 1]] = np.isin(fp[cut[i] : cut[i + 1]].view(np.int64), prints[low + i].values.to_numpy())
                row, first = row[keep], first[keep]
                h = between(prefix(words.hash, ALT_BASE), first, first + window)
                held.append((h, keys[low + row], (first - words.first[row]).astype(np.uint32)))
                n += len(h)
                if n >= FLUSH:
                    yield from combined(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            yield from combined(*map(np.concatenate, zip(*held)))

    def meet(group: pa.Table) -> pa.Table:
        key, at, h, known = unpack(group, np.int64, np.uint32, U, bool)
        if group.column("bucket")[0].as_py() >= 0:
            order = np.argsort(h, kind="stable")
            h, key, at, known = h[order], key[order], at[order], known[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[start, len(h)])
            found = np.repeat((size > 1) | np.logical_or.reduceat(known, start), size)
            key, at = key[found], at[found]
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        return pa.Table.from_batches([pack((key.view(U) % U(buckets)).astype(np.int64), key, at)])

    def gather(group: pa.Table) -> pa.Table:
        key, at = unpack(group, np.int64, np.uint32)
        order = np.lexsort((at, key))
        return pa.Table.from_batches([pack(key[order], at[order], name="key")])

    packed = suspects.select("key", "fps", "text").mapInArrow(hashed, "bucket long, " + ", ".join(f"c{i} binary" for i in range(4)))
    answers = packed.groupBy("bucket").applyInArrow(meet, "bucket long, c0 binary, c1 binary")
    return answers.groupBy("bucket").applyInArrow(gather, "key long, c0 binary").withColumnRenamed("c0", "starts")


def kept_words(words: Words, low: int, high: int, starts: list[bytes | None], window: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For each row: words, words removed, and the kept words joined by single spaces."""
    change = np.zeros(len(words.hash) + window + 1, np.int32)
    for i, s in enumerate(starts):
        if s:
            first = np.unique(np.frombuffer(s, np.uint32)).astype(np.int64) + words.first[i]
            change[first] += 1
            change[first + window] -= 1
    keep = np.cumsum(change[: len(words.hash)]) == 0
    total = np.diff(words.first)
    row = np.repeat(np.arange(len(total)), total)
    n_kept = np.bincount(row[keep], minlength=len(total))
    at = np.flatnonzero(keep)
    last = np.ones(len(at), bool)
    last[:-1] = row[at][1:] != row[at][:-1]
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start[at]] += 1
    edge[words.end[at]] -= 1
    inside = np.cumsum(edge[:-1]).astype(bool)
    data = words.data.copy()
    gap = words.end[at[~last]]
    data[gap] = 0x20
    inside[gap] = True
    ends = np.r_[0, np.cumsum(inside)][words.offsets]
    whole = data[inside].tobytes()
    return total, total - n_kept, [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, batches: int = 3, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row of docs (doc_id, text).

    The documents enter the index in ``batches`` batches, as they would day by
    day; windows are judged on all of them.
    """
    key = F.xxhash64("doc_id", "text")
    docs = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    index = FingerprintIndex(docs.sparkSession, window=window, gram=gram)
    for i in range(batches):
        index.ingest(docs.filter(F.pmod("key", F.lit(batches)) == i))
    suspects = docs.join(index.probe(docs), "key").select("key", "fps", "text")
    starts = _repeated_windows(suspects, window, gram)

    def final(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for low, high, data, offsets in chunks(batch.column(1)):
                total, gone, kept = kept_words(Words(data, offsets), low, high, batch.column(2).slice(low, high - low).to_pylist(), window)
                out = [batch.column(0).slice(low, high - low), pa.array(total), pa.array(gone), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    out.append(pa.array([x.decode() for x in kept], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(out, names)

    done = docs.join(starts, "key", "left").select("doc_id", "text", "starts")
    return done.mapInArrow(final, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
