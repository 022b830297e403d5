"""Merkle dataset manifest by mountain ranges.

H is the lowercase hex SHA-256 of its inputs, concatenated.  A row's leaf is H of its
fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.  The leaves
of a source ascend by doc_id; while a source has several nodes, each run of FANOUT
consecutive ones becomes their H, the last run being shorter, even of one.  What
remains is the source's subroot, a lone leaf itself.  Subroots in the order of their
sources, null first, then by UTF-8 bytes, give the root in the same way.

Leaves are sorted by ranges, so a source of any size is spread over partitions, and
get their position within the source.  A scan of positioned leaves keeps a mountain
range: a stack with the completed peaks of each level, where a carry in base FANOUT
turns a full aligned run into a node of the next level and emits it.  Leaves before the
first aligned position and the peaks left at the end are loose; runs that span scans,
and the short last ones, are merged by joins a level at a time, from at most
2 (FANOUT - 1) loose nodes a level, scan and source.  No padding is ever hashed.

Proofs: the steps above a run are shared by its leaves, so they are built top-down,
once a run, and meet the leaves in one shuffle.

Rows with equal ids are ordered by their leaf and are otherwise separate; null ids come
first and are never tampered with.  Null and empty fields differ (``-`` and ``0:``).
Other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import table

FANOUT = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_NODE = "tree string, level int, run bigint, hash string, children array<string>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**other: Column) -> Column:
    """H of a row's fields; ``other`` replaces the value of a field."""
    return F.sha2(F.concat(*(field(other.get(name, F.col(name))) for name in FIELDS)), 256)


def tree_key(source: Column) -> Column:
    """A string that is not null and sorts as sources do."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place within its tree in the task; rows come sorted by tree."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("tree").dictionary_encode()
        names, slot = codes.dictionary.to_pylist(), np.asarray(codes.indices)
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        if names[slot[0]] == last:
            place[: first[1] if len(first) > 1 else len(slot)] += seen
        last, seen = names[slot[-1]], int(place[-1]) + 1
        yield pa.record_batch([*batch.columns, pa.array(np.full(len(slot), part), pa.int32()), pa.array(place, pa.int64())], names=[*batch.schema.names, "part", "place"])


def positioned(items: DataFrame, order: list[str]) -> DataFrame:
    """``items`` (tree, hash, …), sorted by tree and ``order``, with ``pos`` from 0 within the tree."""
    rows = items.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ["tree", *order, "_tie"]]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = table(rows.mapInArrow(_count_runs, f"{kinds}, part int, place bigint"), "sorted")
    # a row for each task: only the first tree of a task can have begun in an earlier one
    ends = rows.groupBy("part").agg(F.min("tree").alias("first"), F.max("tree").alias("last"), F.max(F.struct("tree", "place"))["place"].alias("place")).orderBy("part").collect()
    tree, n, begun = None, 0, []
    for e in ends:
        before = n if e["first"] == tree else 0
        begun.append((e["part"], e["first"], before))
        tree, n = e["last"], e["place"] + 1 + (before if e["first"] == e["last"] else 0)
    starts = rows.sparkSession.createDataFrame(begun, "part int, _first string, _before bigint")
    held = rows.join(F.broadcast(starts), "part")
    return held.withColumn("pos", F.col("place") + F.when(F.col("tree") == F.col("_first"), F.col("_before")).otherwise(0)).drop("part", "place", "_first", "_before")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def mountain_range(batches: Iterator[pa.RecordBatch], *, fanout: int = FANOUT) -> Iterator[pa.RecordBatch]:
    """Nodes of ascending stretches of leaves (tree, pos, hash).

    A completed run: its tree, level, number, hash and children.  A loose node, one
    that no run of the stretch has taken: children null, ``run`` its own number.
    """
    out: list[tuple] = []
    levels: list[list[tuple[int, str]]] = []  # the last peaks of each level: number and hash
    tree, at = None, -1

    def flush() -> None:
        for level, peaks in enumerate(levels):
            out.extend((tree, level, number, peak, None) for number, peak in peaks)
        levels.clear()

    def push(number: int, value: str) -> None:
        level = 0
        while True:
            if len(levels) <= level:
                levels.append([])
            peaks = levels[level]
            peaks.append((number, value))
            if number % fanout != fanout - 1:
                return
            if len(peaks) < fanout:  # the run began before this stretch
                out.extend((tree, level, k, peak, None) for k, peak in peaks)
                peaks.clear()
                return
            children = [peak for _, peak in peaks]
            peaks.clear()
            number, value = number // fanout, digest(children)
            out.append((tree, level, number, value, children))
            level += 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "level", "run", "hash", "children"])

    for batch in batches:
        for t, pos, value in zip(batch.column("tree").to_pylist(), batch.column("pos").to_pylist(), batch.column("hash").to_pylist(), strict=True):
            if t != tree or pos != at + 1:
                flush()
                tree = t
            at = pos
            push(pos, value)
        yield batch_of(out)
        out.clear()
    flush()
    yield batch_of(out)


def grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(runs, roots, height) of positioned leaves.

    runs (tree, level, run, hash, children) has every run; roots (tree, n, height, root)
    a row for each tree; height is the greatest of them.
    """
    nodes = table(leaves.select("tree", "pos", "hash").mapInArrow(mountain_range, _NODE), "nodes")
    sizes = table(leaves.groupBy("tree").agg((F.max("pos") + 1).alias("n")), "sizes")
    most = sizes.agg(F.max("n")).head()[0] or 0
    height = 0
    while FANOUT**height < most:
        height += 1
    sizes = sizes.withColumn("height", sum((F.when(F.col("n") > FANOUT**k, 1).otherwise(0) for k in range(height)), F.lit(0)))
    runs, merged = nodes.where("children is not null"), None
    for level in range(height):
        loose = nodes.where((F.col("level") == level) & F.col("children").isNull()).select("tree", F.col("run").alias("number"), "hash")
        if merged is not None:
            loose = loose.unionByName(merged.select("tree", F.col("run").alias("number"), "hash"))
        open_trees = sizes.where(F.col("height") > level).select("tree")
        run = F.floor(F.col("number") / FANOUT).alias("run")
        met = loose.join(open_trees, "tree", "left_semi").groupBy("tree", run).agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "hash"))), lambda x: x["hash"]).alias("children"))
        merged = table(met.select("tree", F.lit(level).alias("level"), "run", F.sha2(F.array_join("children", ""), 256).alias("hash"), "children"), "merged")
        runs = runs.unionByName(merged)
    tops = runs.join(sizes.select("tree", "height"), "tree").where("level = height - 1").select("tree", F.col("hash").alias("root"))
    lone = leaves.where("pos = 0").join(sizes.where("n = 1").select("tree"), "tree", "left_semi").select("tree", F.col("hash").alias("root"))
    return runs, sizes.join(table(tops.unionByName(lone), "roots"), "tree"), height


def _step(place: Column) -> Column:
    """What stands beside a child of ``children``: all before it, all after it."""
    child = place.cast("int")
    return F.struct(
        F.array_join(F.slice("children", F.lit(1), child), "").alias("left"),
        F.array_join(F.slice("children", child + 2, F.lit(FANOUT)), "").alias("right"),
    )


def paths(runs: DataFrame, roots: DataFrame, height: int, above: DataFrame) -> DataFrame:
    """(tree, root, run, children, path): for each run of leaves the steps from its hash up, ended by the tree's own of ``above`` (tree, path)."""
    ended = roots.join(above, "tree").select("tree", "root", "height", F.lit(0).cast("long").alias("number"), "path")
    nodes = None
    for level in reversed(range(height)):
        starting = ended.where(F.col("height") == level + 1).select("tree", "root", "number", "path")
        nodes = starting if nodes is None else nodes.unionByName(starting)
        here = runs.where(F.col("level") == level).select("tree", F.col("run").alias("number"), "children").join(nodes, ["tree", "number"])
        if level == 0:
            return here.withColumnRenamed("number", "run")
        child = F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("child")
        nodes = here.select("tree", "root", "number", "children", "path", child).select("tree", "root", (F.col("number") * FANOUT + F.col("child")).alias("number"), F.concat(F.array(_step(F.col("child"))), "path").alias("path"))
    return ended.where("false").select("tree", "root", F.col("number").alias("run"), F.array().cast("array<string>").alias("children"), "path")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the steps above it give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(df: DataFrame, tampered: Column | None = None) -> DataFrame:
    """A row for each of ``df``: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``tampered`` is the leaf of a row as it is found at verification, null where it is
    untouched; the fold starts there.
    """
    changed = F.lit(None).cast("string") if tampered is None else tampered
    leaves = table(df.select("doc_id", tree_key(F.col("source")).alias("tree"), leaf().alias("hash"), changed.alias("changed")), "leaves")
    placed = positioned(leaves, ["doc_id", "hash"])
    runs, subroots, height = grow(placed)
    tops = positioned(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("root").alias("hash")), ["own"])
    top_runs, top_roots, top_height = grow(tops)
    roots = top_roots.select(F.col("root").alias("top"))  # one row, none for an empty table
    none = F.array().cast("array<struct<left:string,right:string>>")
    lone = tops.join(top_roots.where("n = 1").select("tree"), "tree", "left_semi").select(F.col("own").alias("tree"), none.alias("path"))
    top_paths = paths(top_runs, top_roots, top_height, top_roots.select("tree", none.alias("path")))
    place = F.pmod("pos", F.lit(FANOUT))
    met = tops.withColumn("run", F.floor(F.col("pos") / FANOUT)).join(top_paths, ["tree", "run"]).select(F.col("own").alias("tree"), F.concat(F.array(_step(place)), "path").alias("path"))
    above = table(met.unionByName(lone), "above")
    shared = paths(runs, subroots, height, above)
    lone_leaves = subroots.where("n = 1").join(above, "tree").select("tree", "root", F.lit(0).cast("long").alias("run"), F.array("root").alias("children"), "path")
    held = placed.withColumn("run", F.floor(F.col("pos") / FANOUT)).join(shared.withColumn("lone", F.lit(False)).unionByName(lone_leaves.withColumn("lone", F.lit(True))), ["tree", "run"])
    held = held.select("doc_id", "hash", "changed", F.col("root").alias("subroot"), F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(_step(place)), "path")).alias("path"))
    held = held.crossJoin(F.broadcast(roots.limit(1)))  # one row
    steps = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    folded = held.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.col("top").alias("root"), F.sha2(F.array_join(steps, ""), 256).alias("proof_sha256"), fold(F.coalesce("changed", "hash"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered() -> Column:
    """The leaf after A-Z of the text became a-z, where 5 divides the crc32 of the id; null elsewhere."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(text=F.translate("text", _UPPER, _LOWER)))
