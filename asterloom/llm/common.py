"""What the operators of this subpackage share: tables, the shared scratch folder, and digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word of a text, for the JVM's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.  Where it is unset, as in tests, one of our own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="asterloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Tables written in the scopes that are open, innermost last: (table, folder).
_SCOPES: list[list[tuple[DataFrame, str]]] = []


def written(df: DataFrame, what: str, options: dict[str, str | int] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the lineage and outlives any executor.  ``options``: the writer's."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    if _SCOPES:
        _SCOPES[-1].append((table, path))
    return table


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written``."""
    _delete(df.sparkSession, df._folder)


class Scope:
    """Within it, tables made by ``written`` last until its end; those that are kept last on, for a result that reads them."""

    def __enter__(self) -> Scope:
        self.kept: list[DataFrame] = []
        _SCOPES.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __exit__(self, *_) -> None:
        for table, folder in _SCOPES.pop():
            if not any(table is k for k in self.kept):
                _delete(table.sparkSession, folder)
            elif _SCOPES:
                _SCOPES[-1].append((table, folder))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column | str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
