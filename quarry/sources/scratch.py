"""Lineage cuts: tables in the folder that the cluster names in spark.checkpoint.dir, deleted when superseded."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a new folder of this machine, on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def delete(spark: SparkSession, folder: str) -> None:
    """A folder of any file system that Spark can reach."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_folder(spark).rstrip('/')}/quarry-core-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_clean, spark, _ROOTS[app])
    return _ROOTS[app]


def _clean(spark: SparkSession, root: str) -> None:
    try:
        delete(spark, root)
    except Exception:  # the session may be gone at exit; the cluster's clean-up has the folder then
        pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs no more than the step at hand."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing to come reads."""
    for df in tables:
        if path := df.__dict__.pop("cut_path", None):
            delete(df.sparkSession, path)


@contextlib.contextmanager
def bucketed(df: DataFrame, buckets: int, *keys: str) -> Iterator[DataFrame]:
    """``df`` as a table in buckets of ``keys``: joins on these shuffle the other side alone.  It goes with the block."""
    spark = df.sparkSession
    name, path = f"quarry_{uuid.uuid4().hex}", f"{_root(spark)}/{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)


@contextlib.contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of the shared one, which goes with the block."""
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with a row number from 0 in the given order: sorted by ranges, then each range adds the sizes of those before it."""
    rows = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within).select(*df.columns, name)
