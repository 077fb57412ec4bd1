"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits into a sequence.  The
linear program asks for the fewest configurations that hold all pieces; its
dual prices lengths, and a configuration of greatest price is a knapsack.  The
program is solved by multiplicative weights: of the configurations known, those
that cost most weigh most, and prices of lengths rise of which these hold too
few.  A knapsack dynamic program over the capacity finds the configurations that
cost more than the prices allow, which become known too; divided by the greatest
cost of any, prices give a lower bound on the number of sequences.  Solutions
that these prices lead to are rounded down, and what is left of the histogram is
packed by the same prices, so that every sequence is a priced configuration.
All this takes the histogram only: one number a length.

A full piece is a sequence.  The others are put into slots by rank within their length.  Ranks come from a
histogram over hash bins and a sort within a bin, so no length, not even one
that a third of all pieces have, is collected in one task.

Defined results: a null text is empty; each document has at least its end id.
Rows that repeat a document are packed each.  An empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

CAPACITY = 2048
END_ID = 0
#: Rounds of pricing, steps of multiplicative weights in each, and how fast waste raises the prices that guide a pass.
ROUNDS, WEIGHT_STEPS, WASTE_STEP = 12, 600, 1.0
#: A solution is near enough at this share above the bound.
NEAR = 1e-4
#: Solutions within this share of the best are rounded, and the one of fewest sequences is taken.
NEARLY, ROUNDED = 2e-3, 8
#: In a pass, configurations made before the knapsack is solved again, and how much less than the best one may be worth.
PER_PRICING, PRICING_SLACK = 64, 0.002
#: Bins over which the ranks of one length are dealt: so many at least, and one for each so many pieces.
BINS, PER_BIN = 512, 50_000


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents longer than ``capacity`` are cut so that all pieces but the first are full."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                start, end = 0, (len(ids) - 1) % capacity + 1
                piece = 0
                while start < len(ids):
                    rows.append((i, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start, end, piece = end, end + capacity, piece + 1
            at, *rest = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(rest[0], pa.int32()), *(pa.array(c, pa.int64()) for c in rest[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(doc_id, "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Lists of (lengths in a sequence, number of such sequences).

    ``rounded`` has the program's own configurations, ``rest`` what rounding left,
    ``full`` pieces of full length.  Without ``full``, no plan has fewer sequences
    than ``bound``, and the program's solution has ``columns`` configurations.
    """

    rounded: list[tuple[dict[int, int], int]] = field(default_factory=list)
    rest: list[tuple[dict[int, int], int]] = field(default_factory=list)
    full: list[tuple[dict[int, int], int]] = field(default_factory=list)
    bound: float = 0.0
    columns: int = 0


def _knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room: the greatest price of a multiset of lengths that fits, and one length of it (-1: leave a token free)."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        fits = int(np.searchsorted(lengths, room, "right"))
        reach = value[room - lengths[:fits]] + price[:fits]
        best = int(reach.argmax())
        value[room], pick[room] = (reach[best], best) if reach[best] > value[room - 1] else (value[room - 1], -1)
    return value, pick


def _column_with(k: int, lengths: np.ndarray, pick: np.ndarray, capacity: int) -> tuple:
    """The configuration of greatest price among those that hold length number ``k``, as sorted (length number, times)."""
    found, room = {k: 1}, capacity - int(lengths[k])
    while room > 0:
        if (j := int(pick[room])) < 0:
            room -= 1
        else:
            found[j] = found.get(j, 0) + 1
            room -= int(lengths[j])
    return tuple(sorted(found.items()))


def _filled(price: np.ndarray, lengths: np.ndarray, limit: np.ndarray, value: np.ndarray, capacity: int) -> dict[int, int]:
    """A configuration of great price, each length at most ``limit`` times: at each step the length that the knapsack's values favour, the longest of equals."""
    found: dict[int, int] = {}
    room = capacity
    while fits := int(np.searchsorted(lengths, room, "right")):
        gain = np.where(limit[:fits] > 0, price[:fits] + value[room - lengths[:fits]], -1)
        if (top := gain.max()) < 0:
            break
        k = int(np.flatnonzero(gain >= top - 1e-9)[-1])
        found[k] = found.get(k, 0) + 1
        room -= int(lengths[k])
        if found[k] >= limit[k]:
            limit = limit.copy()
            limit[k] = 0
    return found


def _best_configuration(price: np.ndarray, lengths: np.ndarray, limit: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack: a multiset of lengths of great price, each at most ``limit`` times; of greatest price where no limit is met."""
    return _filled(price, lengths, limit, _knapsack(price, lengths, capacity)[0], capacity)


def _pass(price: np.ndarray, lengths: np.ndarray, amount: np.ndarray, capacity: int, whole: bool) -> tuple[list[tuple[dict[int, int], float]], np.ndarray]:
    """Uses up ``amount`` by configurations of great price: (configuration, how often), and each one's price by the greatest at its time.

    Unless ``whole``, a configuration may hold a length any number of times and be used a fraction of a time.
    """
    left = amount.astype(np.int64 if whole else float)
    made, worth = [], []
    while (alive := np.flatnonzero(left > (0 if whole else 1e-9))).size:
        some, cost, have = lengths[alive], price[alive], left[alive]
        value, _ = _knapsack(cost, some, capacity)
        for i in range(PER_PRICING):
            limit = have if whole else np.where(have > 1e-9, np.inf, 0)
            found = _filled(cost, some, limit, value, capacity)
            got = sum(m * cost[k] for k, m in found.items()) / value[capacity]
            if not found or i and got < 1 - PRICING_SLACK:
                break
            times = min(have[k] // m if whole else have[k] / m for k, m in found.items())
            for k, m in found.items():
                have[k] -= m * times
            made.append(({int(alive[k]): m for k, m in found.items()}, times))
            worth.append(got)
        left[alive] = have
    return made, np.array(worth)


def _priced(pool: list[tuple], price: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Multiplicative weights on the program that has the configurations of ``pool`` only: prices near its best ones.

    Configurations weigh exponentially by how far their price is from the limit;
    a length's price rises while these weights hold too little of it, and falls while too much.
    """
    row = np.repeat(np.arange(len(pool)), [len(c) for c in pool])
    k, m = (np.array([x[i] for c in pool for x in c], np.int64) for i in (0, 1))
    best, best_price = 0.0, price
    for t in range(WEIGHT_STEPS):
        load = np.bincount(row, m * price[k], len(pool))
        price, load = price / load.max(), load / load.max()
        total = float((count * price).sum())
        if total > best:
            best, best_price = total, price
        weight = np.exp(40 * (1 + t / 100) * (load - 1))
        held = np.bincount(k, m * weight[row], len(price)) / weight.sum() / count
        price = price * np.exp(0.02 / np.sqrt(1 + t / 50) * np.clip(1 - held * total, -3, 1))
    return best_price


def _first_prices(lengths: np.ndarray, count: np.ndarray, capacity: int) -> np.ndarray:
    """The best for the bound among volumes and the classical step prices (1, 2, 3 pieces a sequence)."""
    volume = lengths / capacity
    step = [np.where((n + 1) * lengths % capacity == 0, volume, (n + 1) * lengths // capacity / n) * 0.999 + 1e-3 * volume for n in (1, 2, 3)]
    return max([volume, *step], key=lambda p: (count * p).sum() / _knapsack(p, lengths, capacity)[0][capacity])


def solve(lengths: np.ndarray, count: np.ndarray, capacity: int) -> tuple[list[tuple[list[tuple[dict[int, int], float]], np.ndarray]], float]:
    """The linear program: its best solutions, and the dual bound on the number of sequences.

    A solution has configurations by length number, how often each is used, and the prices that made it.

    Each round prices by the knapsack: divided by the greatest price of any
    configuration, prices are feasible for the dual, which gives a bound.  Every
    length's best configuration that costs more than the limit enters the pool, and
    multiplicative weights set new prices.  A pass over the histogram by these
    prices gives a solution; where its configurations are worth little, the
    prices that guide the next pass rise.
    """
    price = _first_prices(lengths, count, capacity)
    pool: dict[tuple, None] = {}
    bound, cost, found, guide = 0.0, np.inf, [], lengths / capacity
    for r in range(ROUNDS):
        value, pick = _knapsack(price, lengths, capacity)
        feasible = price / value[capacity]
        improved = (count * feasible).sum() > bound * (1 + 1e-6)
        bound = max(bound, float((count * feasible).sum()))
        pool.update(dict.fromkeys(_column_with(int(k), lengths, pick, capacity) for k in np.flatnonzero(price + value[capacity - lengths] > 1 + 1e-4)))
        for by in (feasible, guide) if improved else (guide,):
            made, worth = _pass(by, lengths, count, capacity, whole=False)
            pool.update(dict.fromkeys(tuple(sorted(c.items())) for c, _ in made))
            used = sum(t for _, t in made)
            cost = min(cost, used)
            found.append((used, made, by))
        lost = np.zeros(len(lengths))
        for (c, t), w in zip(made, worth):
            for k, m in c.items():
                lost[k] += m * t * (1 - w)
        guide = guide * np.exp(WASTE_STEP * lost / count)
        if cost <= bound * (1 + NEAR) + 0.5:
            break
        price = _priced(list(pool), feasible, count)
    return [(made, by) for used, made, by in sorted(found, key=lambda x: x[0]) if used <= cost * (1 + NEARLY) + 1], bound


def plan_of(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan that holds exactly the histogram: the program's solution rounded down, and what is left by its prices."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), np.int64)
    count = np.array([histogram[int(k)] for k in lengths], np.int64)
    plan = Plan()
    if full := histogram.get(capacity, 0):
        plan.full = [({capacity: 1}, full)]
    if not len(lengths):
        return plan
    named = lambda c: {int(lengths[k]): m for k, m in c.items()}
    solutions, plan.bound = solve(lengths, count, capacity)
    fewest = None
    for solution, guide in solutions[:ROUNDED]:
        left, rounded, rest = count.copy(), [], []
        for c, t in solution:
            # Down, but for the last bits of a sum of fractions.
            times = min(int(t + 1e-6), *(int(left[k] // m) for k, m in c.items()))
            if times:
                for k, m in c.items():
                    left[k] -= m * times
                rounded.append((c, times))
        if left.any():  # by the solution's prices, or longest first
            rest = min((_pass(by, lengths, left, capacity, whole=True)[0] for by in (guide, (lengths / capacity) ** 2)), key=lambda made: sum(t for _, t in made))
        total = sum(t for _, t in rounded + rest)
        if fewest is None or total < fewest:
            fewest, plan.columns = total, len(solution)
            plan.rounded, plan.rest = [(named(c), t) for c, t in rounded], [(named(c), int(t)) for c, t in rest]
        if fewest <= np.ceil(plan.bound - 1e-6):
            break
    return plan


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths in a sequence, number of such sequences), holding exactly the histogram."""
    plan = plan_of(histogram, capacity)
    return plan.rounded + plan.rest + plan.full


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of runs of slots, and the first sequence and the offset of each run."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for config, times in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            for _ in range(config[length]):
                runs.setdefault(length, []).append((ranks.get(length, 0), sequence, offset))
                ranks[length] = ranks.get(length, 0) + times
                offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}


def pack(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset; full pieces have negative sequence ids."""
    cut = written(cut, "pack-pieces")
    whole = cut.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    cut = cut.filter(F.col("length") < capacity)
    n_bins = max(BINS, -(-cut.count() // PER_BIN))
    cut = cut.withColumn("bin", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_bins)).cast("int"))
    bins = written(cut.groupBy("length", "bin").count(), "pack-bins")
    histogram = {int(r.length): int(r.n) for r in bins.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # fewer than ``capacity`` rows
    slots = _slots(configurations(histogram, capacity))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn("base", F.coalesce(before, F.lit(0))).select("length", "bin", "base")
    within = F.row_number().over(Window.partitionBy("length", "bin").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("within", within).join(bins, ["length", "bin"]).withColumn("rank", F.col("base") + F.col("within") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for k in np.unique(n):
            first, seq, off = slots[int(k)]
            at = n == k
            run = np.searchsorted(first, r[at], "right") - 1
            sequence[at], offset[at] = seq[run] + r[at] - first[run], off[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("slot", place("length", "rank"))
    placed = placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("slot.sequence_id").alias("sequence_id"), F.col("slot.offset").alias("offset"))
    return placed.unionByName(whole)
