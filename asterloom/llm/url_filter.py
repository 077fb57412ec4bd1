"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

Native: DataFrame functions only.  Every distinct (host, path) is expanded into
the (host suffix, path prefix) expressions whose shape - number of host labels,
length of the path prefix - some rule has; the SHA-256 digests of expressions
and rules are equi-joined on their first ``PREFIX_HEX`` hex digits, then the
full digests are compared, and of the rules that fit the longest wins (host and
path together; of two as long, the one with the longer host, then ``block``).

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule, so it gets ``default``.  Repeated rows are judged each.  An
empty table gives an empty result.  Only the named columns are read, so others
may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

PREFIX_HEX = 8
#: Rules up to this number are broadcast (about 200 bytes each); beyond it Spark plans the join by its own sizes.
BROADCAST_RULES = 50_000
SPLIT = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, SPLIT, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rules_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, text) pairs such as ("block", "com/en/") as the rules' table."""
    literals = [F.struct(F.lit(v).alias("verdict"), F.lit(t).alias("rule")) for v, t in rules or [("", "")]]
    rows = spark.range(1).select(F.inline(F.array(*literals))).filter("rule != ''")
    at = F.instr("rule", "/")
    rows = rows.withColumn("r_host", ascii_lower(F.expr(f"substring(rule, 1, instr(rule, '/') - 1)"))).withColumn("r_path", F.col("rule").substr(at, F.length("rule")))
    return rows.withColumn("digest", _digest(F.col("r_host"), F.col("r_path")))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every row of ``pages``."""
    urls = pages.select(*[F.col(k) for k in keep], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    shape = F.struct((F.size(F.split("r_host", r"\."))).alias("labels"), F.length("r_path").alias("chars"))
    shapes = [(r["s"]["labels"], r["s"]["chars"]) for r in rules.select(shape.alias("s")).distinct().collect()]  # a few: pairs of small numbers
    n_rules = rules.limit(BROADCAST_RULES + 1).count()
    small = F.broadcast if n_rules <= BROADCAST_RULES else (lambda x: x)

    # One row a distinct address, before anything is expanded: the aggregate combines hot addresses where they are read.
    addresses = urls.select("host", "path").filter("host != ''").distinct()
    labels = F.split("host", r"\.", -1)
    if not shapes:
        return urls.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # One expression over a literal of all shapes, however many they are.
    every = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in shapes))
    fits = F.filter(every, lambda s: (F.size(labels) >= s["n"]) & (F.length("path") >= s["c"]))
    tries = F.transform(fits, lambda s: F.struct(F.array_join(F.slice(labels, -s["n"], s["n"]), ".").alias("h"), F.substring(F.col("path"), F.lit(1), s["c"]).alias("p")))
    each = addresses.select("host", "path", F.explode(tries).alias("e"))
    each = each.select("host", "path", _digest(F.col("e.h"), F.col("e.p")).alias("full"))
    each = each.withColumn("short", F.substring("full", 1, PREFIX_HEX))
    found = each.join(small(rules.withColumn("short", F.substring("digest", 1, PREFIX_HEX))), "short").filter("full = digest")
    best = F.max(F.struct(F.length("rule").alias("n"), F.length("r_host").alias("h"), F.col("verdict").alias("v"), F.col("rule").alias("r")))
    won = found.groupBy("host", "path").agg(best.alias("won"))
    return urls.join(won, ["host", "path"], "left").select(*keep, "host", "path", F.col("won.r").alias("rule"), F.coalesce(F.col("won.v"), F.lit(default)).alias("verdict"))
