"""A stored vector index: coarse lists as partitions, of which a search reads those that its queries probe.

``build`` finds centroids on a bounded sample and writes every vector below its group
(a module or label) and its nearest list.  How many lists a query probes is measured,
not guessed: the fewest with which sampled queries find TARGET of their true
neighbours among the sample.  ``search`` takes stated queries in blocks; the lists and
groups that a block needs become partition filters, so other files are not opened.
Each task keeps the best k rows of a query in a buffer of that size, and these alone
are shuffled.

Vectors that are null, empty, zero or of another length than most are kept out of the
index, as no cosine with them is known.  Ties go to the lesser key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TARGET, SAMPLE, QUERIES, MOST_LISTS = 0.97, 8192, 2048, 4096


@dataclass
class Layout:
    """What a search has to know: centroids and how many of them to probe."""

    centroids: np.ndarray
    probes: int
    group: str
    key: str
    schema: StructType


def _matrix(column) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), dtype=np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.random.default_rng(1).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _far(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=k)
        c[count > 0] = sums[count > 0] / count[count > 0, None]
    return c


def _measured_probes(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """The fewest lists with which sampled vectors find TARGET of their k nearest in the sample."""
    asks = x[:: max(1, len(x) // 256)]
    order = _far(asks, c).argsort(1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None], axis=1)
    own = _far(x, c).argmin(1)
    near = (-asks @ x.T).argsort(1)[:, 1 : k + 1]
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(TARGET * len(needed)) - 1)]) + 1 if len(needed) else 1


def _known(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)


def build(vectors: DataFrame, path: str, *, group: str, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> None:
    """Write the index of ``vectors`` (key, group, vector); groups are few, as modules and labels are."""
    rows = vectors.select(key, group, F.col(vector).cast("array<double>").alias("vector")).where(_known(F.col("vector")))
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 30)) < min(1 << 30, (SAMPLE << 30) // max(1, n))).select("vector").limit(2 * SAMPLE).toArrow()["vector"].to_pylist()
    some = some or [r[0] for r in rows.select("vector").limit(1).collect()]
    sizes = [len(v) for v in some]
    dim = max(set(sizes), key=sizes.count) if sizes else 0
    x = _units(np.array([v for v in some if len(v) == dim], dtype=np.float64)) if sizes else np.zeros((0, 0))
    lists = min(MOST_LISTS, max(1, math.isqrt(n) // 2), max(1, len(x)))
    c = _centroids(x, lists) if len(x) else x

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _far(_units(_matrix(batch.column("vector"))), c).argmin(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "list"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.where(F.size("vector") == dim).mapInArrow(assign, f"{kinds}, list int")
    placed.hint("rebalance", group, "list").write.mode("overwrite").partitionBy(group, "list").parquet(f"{path}/lists")
    facts = {"centroids": c.tolist(), "probes": _measured_probes(x, c, k) if len(x) else 1, "group": group, "key": key, "schema": placed.schema.jsonValue()}
    rows.sparkSession.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")


def layout(spark: SparkSession, path: str) -> Layout:
    facts = json.loads(spark.read.text(f"{path}/layout").head()[0])
    return Layout(np.array(facts["centroids"], dtype=np.float64), facts["probes"], facts["group"], facts["key"], StructType.fromJson(facts["schema"]))


def lists_of(spark: SparkSession, path: str, groups: list, numbers: list[int]) -> DataFrame:
    """The stored rows of some groups and lists; the conditions prune partitions."""
    known = layout(spark, path)
    return spark.read.schema(known.schema).parquet(f"{path}/lists").where(F.col(known.group).isin(groups) & F.col("list").isin(numbers))


def search(spark: SparkSession, path: str, queries: DataFrame, *, k: int = 20, probes: int | None = None) -> DataFrame:
    """(query_id, key, similarity, position): the ``k`` most similar stored rows of each query's group; queries (query_id, group, query).

    Queries are a stated set; they are taken QUERIES at a time, each block with one
    scan of the lists it probes.
    """
    known = layout(spark, path)
    asked = queries.select("query_id", known.group, F.col("query").cast("array<double>").alias("query")).where(_known(F.col("query")) & (F.size("query") == known.centroids.shape[-1])).orderBy("query_id")
    kind, name = dict(queries.dtypes)["query_id"], known.schema[known.key].dataType.simpleString()
    out, block = None, []
    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == QUERIES:
            out, block = _union(out, _search_block(spark, path, known, block, k, probes or known.probes, kind, name)), []
    if block or out is None:
        out = _union(out, _search_block(spark, path, known, block, k, probes or known.probes, kind, name))
    return out


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _search_block(spark: SparkSession, path: str, known: Layout, block: list, k: int, probes: int, kind: str, name: str) -> DataFrame:
    schema = f"query_id {kind}, {known.key} {name}, similarity double"
    if not block:
        return spark.createDataFrame([], f"{schema}, position int")
    q = _units(np.array([r["query"] for r in block], dtype=np.float64))
    near = np.argsort(_far(q, known.centroids), axis=1, kind="stable")[:, :probes]
    wanted: dict[tuple, list[int]] = {}
    for n, r in enumerate(block):
        for number in near[n].tolist():
            wanted.setdefault((str(r[known.group]), number), []).append(n)
    ids = [r["query_id"] for r in block]
    shared = spark.sparkContext.broadcast((q, wanted, ids))
    wide = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A buffer of k rows a query."""
        q, wanted, ids = shared.value
        held: dict[int, list[tuple[float, object]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, keys = _units(_matrix(batch.column("vector"))), batch.column(known.key).to_pylist()
            pairs = list(zip(batch.column("_group").to_pylist(), batch.column("list").to_pylist(), strict=True))
            for pair in set(pairs):
                asks = wanted.get(pair)
                if not asks:
                    continue
                rows = np.flatnonzero([p == pair for p in pairs])
                scores = q[asks] @ x[rows].T
                for a, line in zip(asks, scores, strict=True):
                    floor = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                    fresh = [(-float(line[j]), keys[rows[j]]) for j in np.flatnonzero(line >= floor)]
                    held[a] = sorted([*held.get(a, ()), *fresh])[:k]
        found = [(ids[a], key, -s) for a, some in held.items() for s, key in some]
        columns = list(zip(*found, strict=True)) if found else [[]] * 3
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, wide, strict=True)], schema=wide)

    groups, numbers = sorted({r[known.group] for r in block if r[known.group] is not None}), sorted({number for _, number in wanted})
    rows = lists_of(spark, path, groups, numbers).select(known.key, "vector", "list", F.col(known.group).cast("string").alias("_group"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), known.key)
    return rows.mapInArrow(best, schema).withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
