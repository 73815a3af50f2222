"""Session helpers: shared scratch folder, latest-version reduction, table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from spark.checkpoint.dir.

    Only a local master may do without the setting; it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="quillgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillgraph-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove all that this application wrote to the shared folder; to be called when its results are stored elsewhere."""
    remove_path(spark, shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    out = df.write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def latest(df: DataFrame, key: str, version: str, *cols: str) -> DataFrame:
    """One row per key, the one with the greatest version; ties go to the greatest remaining columns.

    Rows with a null key are dropped. An aggregate, so versions are reduced before the shuffle.
    """
    rest = [c for c in (cols or df.columns) if c not in (key, version)]
    top = F.max(F.struct(F.col(version), *rest)).alias("_top")
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(top)
    return out.select(key, f"_top.{version}", *[f"_top.{c}" for c in rest])


def unicode_trim(c: Column) -> Column:
    """Strip whitespace of any kind from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
