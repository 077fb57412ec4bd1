"""Mixing sources to target weights by capped water-filling, natively.

Sizes are words.  The sources share the whole corpus' size by weight; a target
stops at ``max_epochs`` times its source's size, and the excess is shared again
by weight until no target is above its cap.  That fixed point is
``target = min(cap, level * weight)`` with one level for all sources, found
from prefix sums over the sources sorted by cap / weight: no loop.

Every document is taken ``floor(target / size of source)`` whole times.  The
fraction that is left is made of one more repetition of some documents, in a
seeded order: a histogram over 4096 bins of the seeded hash tells the bin
in which the wanted sum falls, whole bins below it are taken, only that bin is
sorted, and the one document of those left out whose size is nearest to what is
still missing is added.  So no source is collected in one task, whatever its
share of the rows.

Defined results: a null text has size 0, a null source is a source of its own
and comes last.  A source without words has target 0 and takes nothing.  Rows
that repeat a document id, a null one included, are separate rows; those of equal
size and source come equally often.  A document without words comes as often as
its place in the order says, though it takes nothing.  An empty table gives an
empty result.  Columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

#: Sources up to this number are broadcast: a row of a few numbers and the name each.
BROADCAST_SOURCES = 10_000


def water_fill(sources: DataFrame, *, max_epochs: int = 3) -> DataFrame:
    """sources (skey, weight, source_size) with ``target`` added; one row a source, so the windows are over sources, not documents."""
    caps = sources.filter("source_size > 0").withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    every = Window.partitionBy()
    filled = (
        caps.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("below", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double"))
        .withColumn("at", (F.col("total") - F.col("below")) / F.col("open"))
        # The first source, by cap / weight, that the level does not fill: from there on all share by weight.
        .withColumn("level", F.min(F.when(F.col("at") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("skey"), F.col("at")))).over(every)["at"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    )
    return sources.join(filled.select("skey", "target"), "skey", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t"))  # null after every name


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, skey, source_size, target, taken, times and a hash of the text (h) of every row of ``docs``; the weights repeat over the sources by code point."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), _source_key(source).alias("skey"), n_words(text).alias("size"), F.xxhash64(text).alias("h"))
    # The order is that of an MD5 digest, which SQL engines share; a bin is its first three hex digits.
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = sized.withColumn("u", order).withColumn("bin", F.conv(F.substring("u", 1, 3), 16, 10).cast("int"))
    sized = written(sized, "mix-sizes")

    bins = sized.groupBy("skey", "bin").agg(F.sum("size").alias("bin_size"))
    bins = written(bins, "mix-bins")
    sources = bins.groupBy("skey").agg(F.sum("bin_size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    sources = water_fill(sources, max_epochs=max_epochs)
    sources = sources.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    sources = sources.withColumn("whole", F.floor("rate").cast("long")).withColumn("want", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    sources = written(sources.select("skey", "source_size", "target", "whole", "want"), "mix-sources")
    small = F.broadcast if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else (lambda x: x)

    so_far = F.sum("bin_size").over(Window.partitionBy("skey").orderBy("bin"))
    fits = F.col("upto") <= F.col("want")
    cut = (
        bins.withColumn("upto", so_far).join(small(sources.select("skey", "want")), "skey")
        .groupBy("skey").agg(F.max(F.when(fits, F.col("bin"))).alias("full"), F.max(F.when(fits, F.col("upto"))).alias("base"), F.min(F.when(~fits, F.col("bin"))).alias("edge"))
    )
    # full: the last bin that is taken whole; edge: the next one that has documents, the only one to be sorted.
    cut = sources.join(small(cut), "skey", "left").select("skey", "source_size", "target", "whole", "want", F.coalesce("full", F.lit(-1)).alias("full"), F.coalesce("base", F.lit(0)).cast("long").alias("base"), F.coalesce("edge", F.lit(-1)).alias("edge"))
    cut = written(cut, "mix-cut")
    placed = sized.join(small(cut), "skey")
    edge = placed.filter("bin = edge")
    run = Window.partitionBy("skey").orderBy("u", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("extra", (F.col("base") + F.sum("size").over(run) <= F.col("want")).cast("int"))
    rest = placed.filter("bin != edge").withColumn("extra", (F.col("bin") <= F.col("full")).cast("int"))
    drawn = written(rest.unionByName(edge).select("doc_id", "skey", "size", "h", "u", "source_size", "target", "whole", "want", "extra"), "mix-drawn")

    sums = drawn.groupBy("skey").agg(F.sum(F.col("extra") * F.col("size")).alias("got"), F.first("want").alias("goal"))
    missing = sums.select("skey", (F.col("goal") - F.col("got")).alias("missing")).filter("missing > 0")
    left = drawn.filter("extra = 0 and size > 0").join(small(missing), "skey").filter("abs(size - missing) < missing")
    nearest = left.groupBy("skey").agg(F.min(F.struct(F.abs(F.col("size") - F.col("missing")).alias("off"), F.col("u"), F.col("doc_id"), F.col("size"))).alias("n"))
    nearest = nearest.select("skey", F.col("n.doc_id").alias("n_doc"), F.col("n.size").alias("n_size"))
    chosen = drawn.join(small(nearest), "skey", "left")
    more = F.when((F.col("extra") == 0) & F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("size") == F.col("n_size")), 1).otherwise(F.col("extra"))
    chosen = chosen.withColumn("times", (F.col("whole") + more).cast("int"))
    return chosen.select("doc_id", "size", "skey", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times", "h")


def repeat(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; the columns stay.

    Rows are found again by id, source and text, so repeated and null ids lose
    nothing.  Rows of a source without any words, which the mix can't share out, come once.
    """
    times = F.when(F.col("source_size") > 0, F.col("times")).otherwise(1)
    mixed = mix(docs, doc_id=doc_id, text=text, source=source, **options).groupBy("doc_id", "skey", "h").agg(F.max(times).alias("times"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), _source_key(source).alias("key"), F.xxhash64(text).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("skey")) & (F.col("hash") == F.col("h"))
    taken = rows.join(mixed.filter("times > 0"), same)
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
