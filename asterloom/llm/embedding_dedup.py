"""Embedding near-dedup over an inverted multi-index.

Each half of the unit vectors has a codebook of its own; a vector's nearest
codewords name its cell in the product grid.  A vector visits cells in order of
the sum of its squared distances to their two codewords, by multi-sequence
traversal, for as many cells as find ``recall`` of
partners at the very threshold, measured on perturbed sample vectors.  In each
visited cell cosines are verified in double precision, block by block.

A pair that either side visits is a link.  Blocks give each vector's number of
links and one edge to the root of its links' forest there, never all pairs; a
pair that both sides visit counts where the smaller id visits.  Exact copies
are one vector with a multiplicity.  Codebooks are fitted on ``SAMPLE``
vectors or ``PER_CODEWORD`` a codeword; they grow with the root of the number of
vectors, so a cell keeps its size.  Every vector is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, as do vectors of different lengths with each
other.  Rows that repeat a vector are copies, linked with each other.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scope, written
from .components import components

#: Vectors that codebooks are fitted on, at least, and for each codeword; and perturbed ones.
SAMPLE, PER_CODEWORD, PERTURBED = 4096, 32, 512
#: Vectors of a cell, and visitors, that one block compares.
INDEX_BLOCK, VISITOR_BLOCK = 4096, 8192
PER_CELL = 800
#: Vectors whose traversals go together.
STEP = 1024


@dataclass
class Grid:
    first: np.ndarray
    second: np.ndarray
    visits: int

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def nearest(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, nearest first, by multi-sequence traversal of its two lists of codewords.

        A cell (i, j) of ranks in the two lists enters a vector's front when (i - 1, j) and
        (i, j - 1) have been visited, so the front has a cell a row at most and
        the nearest cell not yet visited is in it.  All vectors take a step together.
        """
        n, half = min(n, self.cells), self.first.shape[1]
        far = [((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)) for x, c in ((unit[:, :half], self.first), (unit[:, half:], self.second))]
        rank = [d.argsort(1, kind="stable") for d in far]
        a, b = (np.take_along_axis(d, r, 1) for d, r in zip(far, rank))
        b = np.c_[b, np.full(len(unit), np.inf)]  # beyond the last codeword
        rows = min(n, a.shape[1])  # the first n cells are in the first n rows
        column = np.zeros((len(unit), rows), np.int64)  # the next cell of each row of the grid
        cost = np.full((len(unit), rows), np.inf)
        cost[:, 0] = a[:, 0] + b[:, 0]
        every, out = np.arange(len(unit)), np.empty((len(unit), n), np.int64)
        for t in range(n):
            i = cost.argmin(1)
            j = column[every, i]
            out[:, t] = rank[0][every, i] * len(self.second) + rank[1][every, j]
            column[every, i] = j + 1
            # Its right neighbour waits for the row above; the row below waits for its left one.
            above = np.where(i > 0, column[every, i - 1], b.shape[1])
            cost[every, i] = np.where(j + 1 < above, a[every, i] + b[every, j + 1], np.inf)
            has = i + 1 < rows
            below = np.minimum(i + 1, rows - 1)
            free = has & (column[every, below] <= j)
            cost[every[free], below[free]] = a[every[free], below[free]] + b[every[free], column[every[free], below[free]]]
        return out


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(12):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, padded to ``width``, at unit length; and their own lengths."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    size = np.diff(at)
    x = np.zeros((len(size), width))
    x[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
    x /= np.abs(x).max(1, initial=1e-300)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None], size


def fit(classes: DataFrame, width: int, threshold: float, recall: float, n: int) -> Grid:
    k = max(4, int((n / PER_CELL) ** 0.5))
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(max(SAMPLE, PER_CODEWORD * k)).select("embedding").toArrow().column(0).combine_chunks()
    x, _ = _unit(rows, width)
    rng = np.random.default_rng(11)
    half = max(1, width // 2)
    grid = Grid(_codebook(x[:, :half], k, rng), _codebook(x[:, half:], k, rng), 1)
    probe = x[:PERTURBED]
    side = rng.normal(size=probe.shape) * (np.abs(probe) > 0)
    side -= (side * probe).sum(1)[:, None] * probe
    norm = np.sqrt((side * side).sum(1))[:, None]
    moved = threshold * probe + np.sqrt(1 - threshold**2) * np.divide(side, norm, out=np.zeros_like(side), where=norm > 0)
    home = grid.nearest(moved, 1)[:, 0]
    n = 64
    while True:  # until enough of them have met their partner's cell
        met = grid.nearest(probe, n) == home[:, None]
        rank = np.sort(np.where(met.any(1), met.argmax(1), grid.cells))[min(len(probe) - 1, int(recall * len(probe)))]
        if rank < grid.cells or n >= grid.cells:
            break
        n *= 4
    grid.visits = int(min(rank, grid.cells - 1)) + 1
    return grid


def _valid(e: Column) -> Column:
    ok = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return F.coalesce(e.isNotNull() & ok, F.lit(False))


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    classes = written(vectors.filter(_valid(F.col("embedding"))).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    alone = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    grid = fit(classes, width, threshold, recall, n)

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, visitors = np.zeros(grid.cells, np.int64), np.zeros(grid.cells, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                order = grid.nearest(_unit(batch.column(0).slice(low, STEP), width)[0], grid.visits)
                home += np.bincount(order[:, 0], minlength=grid.cells)
                visitors += np.bincount(order.ravel(), minlength=grid.cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(grid.cells)), pa.array(home), pa.array(visitors)], ["cell", "home", "visitors"])

    counts = classes.select("embedding").mapInArrow(census, "cell long, home long, visitors long").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("visitors").alias("visitors")).collect()
    blocks = np.ones((grid.cells, 2), np.int64)  # one row a cell
    for r in counts:
        blocks[r.cell] = max(1, -(-r.home // INDEX_BLOCK)), max(1, -(-r.visitors // VISITOR_BLOCK))
    most = blocks.max(0)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                unit, size = _unit(part.column(0), width)
                rep = part.column(1).to_numpy()
                order = grid.nearest(unit, grid.visits)
                seen = np.sort(order, axis=1).astype(np.int32)  # the cells that it visits
                at, cell, visitor, group = [], [], [], []
                for i in range(len(unit)):
                    for j, c in enumerate(order[i]):
                        mine = rep[i] % blocks[c]
                        if j == 0:  # indexed: once for each block of visitors
                            for v in range(blocks[c, 1]):
                                at.append(i), cell.append(c), visitor.append(False), group.append((c * most[0] + mine[0]) * most[1] + v)
                        for b in range(blocks[c, 0]):
                            at.append(i), cell.append(c), visitor.append(True), group.append((c * most[0] + b) * most[1] + mine[1])
                raw = unit.tobytes()
                step = width * 8
                take = pa.array(at, pa.int32())
                vector, known = pa.array([raw[i * step : (i + 1) * step] for i in range(len(unit))], pa.binary()), pa.array([r.tobytes() for r in seen], pa.binary())
                plain = [pa.array(order[:, 0]), pa.array(size.astype(np.int64)), vector, known, part.column(1), part.column(2)]
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(visitor, pa.bool_()), *(p.take(take) for p in plain)], names)

    names = ["g", "visitor", "home", "size", "vector", "visits", "rep", "copies"]

    def compare(group: pa.Table) -> pa.Table:
        def side(is_visitor: bool):
            t = group.filter(pa.array(group.column("visitor").to_numpy() == is_visitor))
            x = np.frombuffer(b"".join(t.column("vector").to_pylist()), float).reshape(-1, width)
            return x, *(t.column(c).to_numpy() for c in ("rep", "copies", "home", "size")), t

        x, x_rep, x_copies, x_home, x_size, _ = side(True)
        y, y_rep, y_copies, _, y_size, ty = side(False)
        if not len(y):
            return pa.table({"vec": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        cells = np.frombuffer(b"".join(ty.column("visits").to_pylist()), np.int32).reshape(len(y), -1).astype(np.int64)
        cells = (cells + np.arange(len(y))[:, None] * grid.cells).ravel()  # in order
        rep = np.unique(np.r_[x_rep, y_rep])
        px, py = np.searchsorted(rep, x_rep), np.searchsorted(rep, y_rep)
        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for low in range(0, len(x), 1024):
            s = slice(low, low + 1024)
            near = (x[s] @ y.T >= threshold) & (x_size[s, None] == y_size) & (x_rep[s, None] != y_rep)
            a, b = np.nonzero(near)
            if not len(a):
                continue
            asked = b * grid.cells + x_home[s][a]
            once = (cells[np.minimum(np.searchsorted(cells, asked), len(cells) - 1)] != asked) | (x_rep[s][a] < y_rep[b])
            ia, ib = px[s][a], py[b]
            np.add.at(links, ia[once], y_copies[b][once])
            np.add.at(links, ib[once], x_copies[s][a][once])
            while True:
                least = np.minimum(label[ia], label[ib])
                before = label.copy()
                np.minimum.at(label, ia, least)
                np.minimum.at(label, ib, least)
                np.minimum.at(label, before[ia], least)
                np.minimum.at(label, before[ib], least)
                label = label[label]
                if (label == before).all():
                    break
        touched = (links > 0) | (label != np.arange(len(rep)))
        return pa.table({"vec": rep[touched], "links": links[touched], "root": rep[label[touched]]})

    rows = classes.select("embedding", "rep", "copies").mapInArrow(dealt, "g long, visitor boolean, home long, size long, vector binary, visits binary, rep long, copies long")
    with Scope() as scope:
        found = written(rows.groupBy("g").applyInArrow(compare, "vec long, links long, root long"), "vector-links")
        counted = found.groupBy("vec").agg(F.sum("links").alias("links"))
        grouped = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")))
        labels = classes.join(counted.withColumnRenamed("vec", "rep"), "rep", "left").join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
        labels = labels.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        labels = scope.keep(written(labels, "vector-labels"))
    done = vectors.join(labels, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
