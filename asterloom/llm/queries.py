"""The queries of this subpackage, with the parameters used in production, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, embedding_dedup, jaccard, mixing, packing, secrets, substring, token_counts, toxicity, url_filter
from .common import table, written

#: The rules that op9 is asked to apply.
URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of all texts, kept, and then three edits a document: a word put in at a quarter, a stretch replaced in the middle, one taken out at three quarters."""
    trees = written(token_counts.counted(table(spark, sf_dir, "documents")), "token-trees")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda at, size, text: F.struct((n * at / 4).cast("int").alias("start"), ((n * at / 4).cast("int") + size).alias("end"), F.lit(text).alias("text"))
    trees = trees.withColumn("edits", F.array(edit(1, 0, " edited"), edit(2, 12, "rewritten \n"), edit(3, 20, "")))
    return token_counts.edited(trees).select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_encoded_again")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20, as a whole, against all documents."""
    docs = table(spark, sf_dir, "documents")
    index = bm25.written_index(docs)
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(index, asked, query_id="query_id", k=10)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
)
SELECT page_id, host, path,
       (SELECT r.h || r.p FROM r WHERE (p.host = r.h OR p.host LIKE '%.' || r.h) AND starts_with(p.path, r.p) ORDER BY length(r.h || r.p) DESC LIMIT 1) AS rule,
       coalesce((SELECT r.verdict FROM r WHERE (p.host = r.h OR p.host LIKE '%.' || r.h) AND starts_with(p.path, r.p) ORDER BY length(r.h || r.p) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="text")} AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM places),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN twice USING (s), (SELECT unnest(generate_series(0, 34)) AS k)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, cast(len(ws) AS bigint) AS n_words, cast(len(ws) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: The smallest node that links (a, b) lead to, for the nodes of ``every`` (node).
_COMPONENTS = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (
  SELECT node, node FROM every
  UNION
  SELECT b, root FROM reach JOIN both_ways ON a = node WHERE root < b
),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
"""

OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)
  )
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
every AS (SELECT doc_id AS node FROM documents), {_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents JOIN comp ON node = doc_id LEFT JOIN n USING (doc_id)
"""

OP6_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.9),
every AS (SELECT vec_id AS node FROM v), {_COMPONENTS}
SELECT node AS vec_id, (SELECT count(*) FROM both_ways WHERE a = node) AS n_links, component_id, node = component_id AS kept FROM comp
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 't') AS skey, cast(len({_WORDS.format(text="text")}) AS bigint) AS size, md5('17:' || doc_id) AS u FROM documents),
s AS (SELECT skey, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1] AS weight, cast(source_size * 3 AS double) AS cap FROM s),
f AS (
  SELECT *, (sum(cast(source_size AS double)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w WHERE source_size > 0
),
level AS (SELECT arg_min(lvl, (cap / weight, skey)) AS level FROM f WHERE lvl * weight <= cap),
t AS (SELECT w.skey, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, coalesce(level * weight, cap)) END AS target FROM w, level),
p AS (SELECT *, cast(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS bigint) AS whole FROM t),
g AS (SELECT *, greatest(0, cast(round(target - whole * source_size) AS bigint)) AS want FROM p),
x AS (SELECT *, CASE WHEN sum(size) OVER (PARTITION BY skey ORDER BY u, doc_id, size RANGE UNBOUNDED PRECEDING) <= want THEN 1 ELSE 0 END AS extra FROM d JOIN g USING (skey)),
m AS (SELECT skey, any_value(want) - sum(extra * size) AS missing FROM x GROUP BY skey),
near AS (SELECT skey, min((abs(size - missing), u, doc_id)) AS n FROM x JOIN m USING (skey) WHERE extra = 0 AND size > 0 AND abs(size - missing) < missing GROUP BY skey)
SELECT doc_id, size, source_size, target, cast(size * (whole + CASE WHEN extra = 0 AND near.n[3] = doc_id THEN 1 ELSE extra END) AS bigint) AS taken
FROM x LEFT JOIN near USING (skey)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_secret_scan": op2_secret_scan,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_token_counts": op4_token_counts,
        "op5_topk_search": op5_topk_search,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_toxicity": op8_toxicity,
        "op9_url_filter": op9_url_filter,
        "op10_mix": op10_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op3_jaccard_join": OP3_SQL, "op6_embedding_dedup": OP6_SQL, "op9_url_filter": OP9_SQL, "op10_mix": OP10_SQL}
