"""Change detection, reference repair and incremental merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import basename, path_references, replace_references


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state): stale, new, deleted or same; both inputs are (path, hash)."""
    c, m = current.select("path", F.col("hash").alias("now")), manifest.select("path", F.col("hash").alias("then"))
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "stale").otherwise("same")
    return c.join(m, "path", "full_outer").select("path", state.alias("state"))


def module_staleness(changes: DataFrame, assignments: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Per module the share of stale files; stale means strictly over the threshold."""
    hit = assignments.join(changes.where("state = 'stale'").select("path", F.lit(1).alias("x")), "path", "left")
    share = hit.groupBy("module").agg(F.count("*").alias("n_files"), F.count("x").alias("n_stale"))
    return share.withColumn("ratio", F.col("n_stale") / F.col("n_files")).withColumn("is_stale", F.col("ratio") > threshold)


def broken_references(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """(name, ref) of file references of docs (name, text) that no path matches; repeats kept."""
    refs = docs.select("name", F.explode(path_references(F.col("text"))).alias("ref"))
    return refs.join(paths.select(F.col("path").alias("ref")).distinct(), "ref", "left_anti").select("name", "ref")


def decision(changes: DataFrame, broken: DataFrame, full_over: float = 0.50) -> DataFrame:
    """One row: counts, the changed share of the manifest, and full, partial, docs_only or none."""
    sums = changes.agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("stale", "new", "deleted")), F.count_if(F.col("state") != "new").alias("n_manifest"))
    one = sums.crossJoin(F.broadcast(broken.agg(F.count("*").alias("n_broken"))))  # one row each
    ratio = F.col("n_stale") / F.greatest("n_manifest", F.lit(1))
    any_change = (F.col("n_stale") + F.col("n_new") + F.col("n_deleted")) > 0
    what = F.when(ratio > full_over, "full").when(any_change, "partial").when(F.col("n_broken") > 0, "docs_only").otherwise("none")
    return one.withColumn("ratio", ratio).withColumn("decision", what)


def repairs(broken: DataFrame, paths: DataFrame) -> DataFrame:
    """(ref, fix): the shortest path of the same base name (then the least), null where there is none."""
    wanted = broken.select("ref").distinct().withColumn("base", basename(F.col("ref")))
    found = wanted.join(paths.select("path", basename(F.col("path")).alias("base")), "base").groupBy("ref").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("x"))
    return wanted.join(found, "ref", "left").select("ref", F.col("x.path").alias("fix"))


def repaired_documents(docs: DataFrame, broken: DataFrame, fixes: DataFrame) -> DataFrame:
    """Documents with their broken references replaced or removed; others as they are."""
    per = broken.distinct().join(fixes, "ref").groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.col("ref").alias("old"), F.col("fix").alias("new")))).alias("fixes"))
    return docs.join(per, "name", "left").select("name", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(replace_references(F.col("text"), F.col("fixes"))).alias("text"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def merge_extractions(old: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """Extractions after a refresh: stale and new ones replaced by ``fresh``, deleted ones dropped; keyed by path."""
    gone = changes.where(F.col("state").isin("stale", "new", "deleted")).select("path")
    return old.join(gone, "path", "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))
