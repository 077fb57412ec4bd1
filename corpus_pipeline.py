"""A corpus pipeline of five stages over the table ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir), where
docs is what the stage before kept, and returns a DataFrame, which is written
as Parquet and read again for the next stage.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterloom.llm import jaccard, mixing, packing, secrets, toxicity
from asterloom.llm.common import table, written

#: What stands in place of a secret.
REDACTED = "<secret>"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted to be toxic go; all others stay, whatever their ids, also those without text."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard index of 0.8 or more one row stays: of the smallest id, nulls last.

    Rows are told apart by a hash of id and text, not by their ids: rows that
    repeat both are one document, rows that share an id only are judged each by
    its text, and rows without an id like others.  Documents without words link
    with nothing and stay.  Other columns play no part and may have any name.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    found = jaccard.similar_documents(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
    ids = keyed.groupBy(F.col("key").alias("doc_id")).agg(F.min("row.doc_id").alias("id"), F.count("*").alias("rows"))
    groups = found.select("doc_id", "component_id").distinct().join(ids, "doc_id").groupBy("component_id")
    kept = groups.agg(F.min(F.struct(F.col("id").isNull(), "id", F.col("doc_id").alias("key"), "rows")).alias("best")).select("best.key", "best.rows")
    kept = written(kept, "pipeline-kept")
    once = keyed.join(kept.filter("rows = 1"), "key", "left_semi").select("row")
    repeated = keyed.join(kept.filter("rows > 1"), "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows.  Every row stays."""
    clean = secrets.find_secrets(docs, redact=REDACTED)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix of sources takes them: see ``mixing.repeat`` for those without id or words."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: fitted classifiers and a tokenizer are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
