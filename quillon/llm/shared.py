"""Shared folder, cut lineage and small helpers of the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a temporary one where a session on one machine has none (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quillon-"))
    return _own[0]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/quillon-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    path = getattr(df, "_quillon_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of ``docs``; columns beyond them never meet the operators' own names."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def own_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text_col: str):
    """Which text a row has, for rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def release(spark: SparkSession) -> None:
    """Lets the driver collect its garbage, so shuffle files of finished jobs are deleted now instead of some time later."""
    gc.collect()
    spark._jvm.System.gc()
