"""Embedding near-dedup: inverted lists with product quantisation and exact rerank.

Unit vectors are assigned to the nearest of ``lists`` coarse centroids, and
their residual is coded in ``parts`` subspaces of ``words`` code words each.
Each vector is also a query: it probes its nearest list and every list whose
squared distance is within ``margin`` of that, since a near neighbour's list
differs from the own one by little.  In a probed list a lookup table per query
gives asymmetric distances to all codes; by the triangle inequality a code can
only be a near neighbour if that distance is at most the radius plus the code's
own error, so the codes lose no neighbour of a probed list.  What passes is
reranked by the exact cosine in double precision.

The model is fitted on at most about ``sample`` vectors, or 16 a list where that is
more; every vector is indexed.  There are as many lists as the root of the number of
vectors, up to 32,768.  A link counts for both ends, also where only one of them
probes the other's list.
Identical vectors fold into one with a count.  Lists are cut into blocks, so a
label, list or group of copies of any size is spread over many tasks.  A task
returns counts per query and a spanning forest of the links it saw, never pairs.

Vectors are compared within equal, non-null labels and equal lengths.  Null,
empty and zero vectors and those with null or non-finite components link with
nothing.  Equal vectors link.  Rows with equal ids count as separate vectors.
Extra columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import table
from quarry.llm.components import components

MEMBER_BLOCK, QUERY_BLOCK = 2048, 4096
#: A list for so many vectors up to FEW_LISTS lists, then as many as the root of their number, so that probing lists and
#: searching them grow alike; from MOST_LISTS on, a billion vectors, the model stays at 16 MB for 64 dimensions.
LIST_ROWS, FEW_LISTS, MOST_LISTS = 512, 1024, 1 << 15
#: Distances to centroids that are held at a time.
DISTANCES = 1 << 22


def lists_for(n: int) -> int:
    return min(MOST_LISTS, max(1, min(n // LIST_ROWS, max(FEW_LISTS, math.isqrt(n)))))


def clusters(x: np.ndarray, k: int, rounds: int, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds from a seeded start; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, DISTANCES // max(1, len(c)))
    return np.concatenate([squared(x[k : k + step], c).argmin(1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Model:
    """Coarse centroids and one code book per subspace, for vectors of one length."""

    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int, words: int) -> Model:
        centroids = clusters(x, lists, 8)
        rest = x - centroids[nearest(x, centroids)]
        cuts = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
        some = rest[:8192]
        return cls(centroids, [clusters(some[:, a:b], words, 6) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error of each unit vector."""
        own = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = np.stack([nearest(rest[:, a:b], book) for book, a, b in zip(self.books, self.cuts, self.cuts[1:], strict=False)], axis=1).astype(np.uint8)
        back = np.hstack([book[codes[:, k]] for k, book in enumerate(self.books)])
        return own, codes, np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, margin: float) -> list[np.ndarray]:
        step = max(1, DISTANCES // len(self.centroids))
        return [np.flatnonzero(row <= row.min() + margin) for k in range(0, len(x), step) for row in squared(x[k : k + step], self.centroids)]

    def lookup_distances(self, x: np.ndarray, of_list: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to coded members of one list, by a table per query and subspace."""
        rest = x - self.centroids[of_list]
        total = np.zeros((len(x), len(codes)), dtype=np.float32)
        for k, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            total += squared(rest[:, a:b], book).astype(np.float32)[:, codes[:, k]]
        return np.sqrt(total)


def _valid(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.asarray(column.flatten() if hasattr(column, "flatten") else column.combine_chunks().flatten(), dtype=np.float64).reshape(len(column), -1)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # no overflow of squares
    return raw, scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _forest(q: np.ndarray, m: np.ndarray) -> list[tuple[int, int]]:
    """Edges to the least node of each part of the graph with edges (q, m)."""
    nodes, slot = np.unique(np.concatenate([q, m]), return_inverse=True)
    a, b = slot[: len(q)], slot[len(q) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return [(int(nodes[k]), int(nodes[label[k]])) for k in np.flatnonzero(label != np.arange(len(nodes)))]
        label = after


def _searcher(models: dict[int, Model], threshold: float):
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-5

    def search(t: pa.Table) -> pa.Table:
        role = np.asarray(t["query"])
        asks, held = t.filter(pa.array(role)), t.filter(pa.array(~role))
        out: list[tuple[int, int, int]] = []
        if asks.num_rows and held.num_rows:
            raw_q, q = _unit(asks["vector"].combine_chunks())
            raw_m, m = _unit(held["vector"].combine_chunks())
            codes = np.frombuffer(b"".join(held["codes"].to_pylist()), dtype=np.uint8).reshape(held.num_rows, -1)
            error, times = np.asarray(held["error"]), np.asarray(held["times"])
            ids_q, ids_m = np.asarray(asks["fid"]), np.asarray(held["fid"])
            here, home, times_q = t["list"][0].as_py(), np.asarray(asks["home"], dtype=np.int64), np.asarray(asks["times"])
            probed = held["probes"].combine_chunks()
            probed = np.repeat(np.arange(len(m)), np.diff(np.asarray(probed.offsets))) << 32 | np.asarray(probed.flatten(), dtype=np.int64)  # ascending
            back = np.zeros(len(m), dtype=np.int64)
            model = models[raw_q.shape[1]]
            counts, left, right = np.zeros(len(q), dtype=np.int64), [], []
            for lo in range(0, len(q), 256):
                far = model.lookup_distances(q[lo : lo + 256], here, codes)
                i, j = np.nonzero(far <= radius + error[None] + 1e-4)
                other = ids_q[lo + i] != ids_m[j]
                i, j = i[other] + lo, j[other]
                near = np.concatenate([np.einsum("ij,ij->i", q[i[k : k + 65536]], m[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
                i, j = i[near >= threshold], j[near >= threshold]
                counts += np.bincount(i, weights=times[j], minlength=len(q)).astype(np.int64)
                # a member that does not probe the query's list will not find it: the link counts for it here
                asked = j.astype(np.int64) << 32 | home[i]
                at = np.minimum(np.searchsorted(probed, asked), len(probed) - 1)
                once = probed[at] != asked
                back += np.bincount(j[once], weights=times_q[i[once]], minlength=len(m)).astype(np.int64)
                if len(i):
                    edges = _forest(ids_q[i], ids_m[j])
                    left += [a for a, _ in edges]
                    right += [b for _, b in edges]
            out = [(int(ids[k]), int(n[k]), int(ids[k])) for ids, n in ((ids_q, counts), (ids_m, back)) for k in np.flatnonzero(n)]
            out += [(a, 0, b) for a, b in (_forest(np.asarray(left), np.asarray(right)) if left else [])]
        a, n, b = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def near_duplicates(
    df: DataFrame,
    *,
    threshold: float = 0.93,
    margin: float = 0.12,
    parts: int = 16,
    words: int = 64,
    sample: int = 32_768,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``id_col``, n_links, component_id and kept of each row; ids are integers."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    good = rows.where(_valid(F.col("vector")) & F.col("label").isNotNull())
    folded = good.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    folded = table(folded.withColumn("fid", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors")

    models: dict[int, Model] = {}
    for dim, n in folded.groupBy("dim").count().collect():
        lists = lists_for(n)
        want = max(sample, 16 * lists)
        some = folded.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("fid", F.lit(5)), F.lit(1 << 40)) < min(1 << 40, (want << 40) // n)))
        got = some.select("vector").toArrow()["vector"].combine_chunks()
        if len(got) == 0:
            got = folded.where(F.col("dim") == dim).select("vector").limit(1).toArrow()["vector"].combine_chunks()
        models[dim] = Model.fit(_unit(got)[1], lists, parts, words)
    if not models:
        zero = F.lit(0).cast("long")
        return rows.select(F.col("id").alias(id_col), zero.alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    shared = df.sparkSession.sparkContext.broadcast(models)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch["dim"])
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                model = shared.value[dim]
                for lo in range(0, own.num_rows, 2048):
                    part = own.slice(lo, 2048)
                    x = _unit(part["vector"])[1]
                    lists, codes, error = model.encode(x)
                    yield pa.record_batch(
                        [part["fid"], pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float64()), pa.array(model.probes(x, margin), pa.list_(pa.int32()))],
                        names=["fid", "list", "codes", "error", "probes"],
                    )

    coded = folded.select("fid", "dim", "vector").mapInArrow(assign, "fid bigint, list int, codes binary, error double, probes array<int>")
    coded = table(coded, "codes").join(folded.select("fid", "label", "dim", "vector", "times"), "fid")
    key = ["label", "dim", "list"]
    members = coded.select(*key, "fid", "vector", "codes", "error", "times", "probes", F.lit(None).cast("int").alias("home"), F.lit(False).alias("query"))
    asks = coded.select("label", "dim", F.explode("probes").alias("list"), "fid", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), "times", F.lit(None).cast("array<int>").alias("probes"), F.col("list").alias("home"), F.lit(True).alias("query"))
    sizes = members.select(*key, "query").unionByName(asks.select(*key, "query")).groupBy(*key).agg(F.count_if(~F.col("query")).alias("n_members"), F.count_if("query").alias("n_asks")).where("n_members > 0")
    sizes = sizes.select(*key, F.ceil(F.col("n_members") / MEMBER_BLOCK).alias("mb"), F.ceil(F.col("n_asks") / QUERY_BLOCK).alias("qb"))
    both = members.unionByName(asks).join(sizes, key)
    own = F.when(F.col("query"), F.pmod(F.xxhash64("fid"), F.col("qb"))).otherwise(F.pmod(F.xxhash64("fid"), F.col("mb")))
    across = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.col("mb")).otherwise(F.col("qb")) - 1))
    both = both.withColumn("own", own).withColumn("across", across)
    both = both.withColumn("block", F.when(F.col("query"), F.struct(F.col("across").alias("m"), F.col("own").alias("q"))).otherwise(F.struct(F.col("own").alias("m"), F.col("across").alias("q"))))
    both = both.drop("mb", "qb", "own", "across")
    found = table(both.groupBy(*key, "block").applyInArrow(_searcher(models, threshold), "a bigint, n bigint, b bigint"), "near")

    counts = found.groupBy(F.col("a").alias("fid")).agg(F.sum("n").alias("n"))
    parts_of = components(found.where("a <> b").select("a", "b"))
    classes = folded.select("fid", "rep").join(parts_of.withColumnRenamed("node", "fid"), "fid", "left").select("fid", "rep", F.coalesce("component", "fid").alias("part"))
    least = classes.groupBy("part").agg(F.min("rep").alias("component_id"))
    facts = folded.select("fid", "label", "vector", "times").join(counts, "fid", "left").join(classes.select("fid", "part"), "fid").join(least, "part")
    facts = facts.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = rows.join(facts, ["label", "vector"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
