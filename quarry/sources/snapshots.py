"""Keyed tables in slots: a change rewrites the slots of the keys that changed, and readers never see half of it.

A table is a folder with one folder for each version, which holds the slots that this
version wrote, and pointer files, ``pointer-<version>.json``, that name for every slot
the version that wrote it last.  The newest pointer is the table: it is written after
its slots, so a job that fails leaves the table as it was.  A slot is a hash of the key
modulo ``slots``, which grows with the table, so a hot folder or module is spread over all of them.  Versions that
neither the newest nor the KEEP pointers before it name are deleted.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.scratch import cut, delete, drop

SLOTS = 32
#: Earlier pointers whose slots stay, for readers that still hold them.
KEEP = 2
SLOT = "_slot"


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that have a pointer, oldest first."""
    system, where = _hadoop(spark, path)
    if not system.exists(where):
        return []
    names = (f.getPath().getName() for f in system.listStatus(where))
    return sorted(int(m[1]) for m in map(re.compile(r"pointer-(\d+)\.json").fullmatch, names) if m)


def _pointer(spark: SparkSession, path: str, version: int) -> dict:
    text = spark.read.text(f"{path}/pointer-{version}.json", wholetext=True).head()[0]
    return json.loads(text)


def _slot_of(key: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def _rows(spark: SparkSession, path: str, pointer: dict, only: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(pointer["schema"])
    places = [f"{path}/v{v}/{SLOT}={slot}" for slot, v in pointer["slots"].items() if only is None or int(slot) in only]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as of a version, by default the newest; None where there is none."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    return _rows(spark, path, _pointer(spark, path, known[-1] if version is None else version))


def _publish(spark: SparkSession, path: str, version: int, rows: DataFrame, key: str, slots: int, touched: list[int] | None, before: dict | None) -> None:
    """Write the touched slots, all where None, then the pointer; then clear what no pointer of the last ones names."""
    folder = f"{path}/v{version}"
    # rebalanced: a large slot is split over tasks and files, small ones are one file each
    rows.withColumn(SLOT, _slot_of(key, slots)).hint("rebalance", SLOT).write.mode("overwrite").partitionBy(SLOT).parquet(folder)
    system, where = _hadoop(spark, folder)
    written = {f.getPath().getName().partition("=")[2] for f in system.listStatus(where) if "=" in f.getPath().getName()}
    held = {} if touched is None else {s: v for s, v in before["slots"].items() if int(s) not in touched}
    pointer = {"schema": rows.schema.jsonValue(), "key": key, "n": slots, "slots": held | dict.fromkeys(written, version)}
    out = _hadoop(spark, path)[0].create(_hadoop(spark, f"{path}/pointer-{version}.json")[1], True)
    out.write(bytearray(json.dumps(pointer).encode()))
    out.close()
    known = versions(spark, path)
    for old in known[: -1 - KEEP]:
        delete(spark, f"{path}/pointer-{old}.json")
    named = {v for p in known[-1 - KEEP :] for v in _pointer(spark, path, p)["slots"].values()}
    for f in _hadoop(spark, path)[0].listStatus(_hadoop(spark, path)[1]):
        m = re.fullmatch(r"v(\d+)", f.getPath().getName())
        if m and int(m[1]) not in named and int(m[1]) < version:
            delete(spark, f"{path}/{m[0]}")


def forget(spark: SparkSession, path: str, version: int) -> None:
    """Take back a version that is about to be written again, and any later one."""
    for v in versions(spark, path):
        if v >= version:
            delete(spark, f"{path}/pointer-{v}.json")


def write(df: DataFrame, path: str, key: str, *, slots: int = SLOTS, version: int | None = None) -> None:
    """A whole new table."""
    spark = df.sparkSession
    known = versions(spark, path)
    _publish(spark, path, version if version is not None else known[-1] + 1 if known else 0, df, key, slots, None, None)


def upsert(spark: SparkSession, path: str, fresh: DataFrame, *, gone: DataFrame | None = None, version: int | None = None) -> list[int]:
    """Rows of ``fresh`` replace those of their keys, keys of ``gone`` go; the slots that were rewritten, the others are not even read."""
    last = versions(spark, path)[-1]
    before = _pointer(spark, path, last)
    key, slots = before["key"], before["n"]
    fresh = cut(fresh.select(*StructType.fromJson(before["schema"]).fieldNames()))
    keys = fresh.select(key) if gone is None else fresh.select(key).unionByName(gone.select(key))
    touched = sorted(r[0] for r in keys.select(_slot_of(key, slots).alias("s")).distinct().collect())  # at most ``slots``
    if touched:
        merged = _rows(spark, path, before, touched).join(keys.distinct(), key, "left_anti").unionByName(fresh)
        _publish(spark, path, version if version is not None else last + 1, merged, key, slots, touched, before)
    elif version is not None:
        _publish(spark, path, version, fresh, key, slots, [], before)
    drop(fresh)
    return touched


def replace(df: DataFrame, path: str, key: str, *, slots: int = SLOTS) -> list[int]:
    """Make the table equal to ``df``, writing the slots alone in which a row differs; the slots that were."""
    spark = df.sparkSession
    old = read(spark, path)
    if old is None or old.columns != df.columns:
        write(df, path, key, slots=slots)
        return list(range(slots))
    df = cut(df)
    marks = lambda rows, name: rows.groupBy(key).agg(F.bit_xor(F.xxhash64(*rows.columns)).alias(name))
    both = marks(df, "now").join(marks(old, "then"), key, "full_outer")
    changed = cut(both.where(~F.col("now").eqNullSafe(F.col("then"))).select(key))
    fresh = df.join(changed, key, "left_semi")
    touched = upsert(spark, path, fresh, gone=changed)
    drop(df, changed)
    return touched
