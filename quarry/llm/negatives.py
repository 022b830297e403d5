"""Hard-negative mining over one-dimensional distance keys.

Vectors become integers, floor(256 x).  With M the largest squared norm, each gets one
more component, the root of M less its own squared norm, and each query a zero there:
then squared distance = |q|**2 + M - 2 * inner product, so the nearest rows are those
with the highest inner products.  Every row is stored under its nearest pivot, sorted by
(pivot, distance to it), in blocks of at most BLOCK rows that lie in one cell of
distances.  By the triangle inequality a row within r of a query has a distance to its
pivot within r of the query's own, so a round scans, at every pivot, the cells of the
annulus between the last radius and the next.  A query is done once its k-th score is
certified: no row outside the scanned annuli can reach it, ties included, or none can
still lie in the band of scores that it asks for.

Radii: first each query's own cell alone, then half the radius that is needed by what
was found, then all of it, so three rounds end every search.  Open queries alone go on,
and only with scores that can still enter.  Pivots are centroids of at most about
``sample`` rows; they decide the cost alone.

Of rows equal in label and vector only the KEEP with the least ids are stored, since at
most ten of them can be returned beside the anchor itself; queries are never folded.
Blocks meet at most QUERIES queries in a task, so no key is gathered whole; the best k
are taken by a window that first limits each task's own rows.

Rows with a null label or vector, or any null or non-finite component, take no part;
nor do those whose integer components have a squared norm of 2**52 or more, as scores
are then not exact.  Vectors of different length never meet; an empty vector has score 0
with empty ones.  Equal ids are separate rows, an anchor's own row alone is left out;
null ids come last among ties and are never anchors.  Other columns are never read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._base import discard, table
from quarry.llm.vectors import clusters, nearest, squared

BLOCK, QUERIES, KEEP = 1024, 2048, 11
#: A null id among ties.
LAST = (1 << 63) - 1
#: Scores are below 2**52 in size, so these bound every band.
LOWEST, HIGHEST = -(1 << 53), 1 << 53
_ASK = "fid bigint, dim int, label string, vector array<bigint>, self bigint, slots array<struct<lo:bigint,hi:bigint>>, same boolean"


@dataclass
class Keys:
    """Pivots of the vectors of one length, the width of a cell, and each pivot's cells."""

    most: float
    pivots: np.ndarray
    width: float
    first: np.ndarray
    last: np.ndarray

    def slack(self) -> float:
        """More than rounding can add to a distance."""
        return 1e-6 * (1 + math.sqrt(self.most))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    size = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(256.0) * x.cast("double")).cast("double"), F.lit(2.0)))
    return vector.isNotNull() & F.forall(vector, finite) & (size < float(1 << 52))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(pc.list_flatten(column), dtype=np.float64).reshape(len(column), dim)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that makes all norms equal."""
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(x, pivots))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def fitted(rows: DataFrame, sample: int) -> dict[int, Keys]:
    """Keys of each length, without the cells that are filled: sizes and norms by one pass, pivots by a bounded sample."""
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    keys = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect():
        dim, n, most = r["dim"], r["n"], float(r["most"])
        some = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("fid", F.lit(23)), F.lit(1 << 40)) < min(1 << 40, (sample << 40) // n)))
        got = some.select("vector").limit(2 * sample).toArrow()["vector"]
        if not len(got):
            got = rows.where(F.col("dim") == dim).select("vector").limit(1).toArrow()["vector"]
        x = lifted(matrix(got, dim), most)
        pivots = clusters(x, min(256, max(1, math.isqrt(n) // 8)), 6)
        near = _distances(x, pivots).min(1)
        cells = max(1, n // (len(pivots) * BLOCK // 2))  # so that a cell holds about half a block
        width = max(float(np.ptp(near)) / cells, 1e-3 * (1 + math.sqrt(most)))
        keys[dim] = Keys(most, pivots, width, np.zeros(len(pivots), np.int64), np.full(len(pivots), -1, np.int64))
    return keys


def stored(rows: DataFrame, keys: dict[int, Keys]) -> DataFrame:
    """The index: blocks (block, dim, pivot, cell, fids, ids, labels, vectors), cut from rows sorted by (pivot, distance)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in _by_dim(batch):
                k = keys[dim]
                x = lifted(matrix(own.column("vector"), dim), k.most)
                pivot = nearest(x, k.pivots)
                far = np.sqrt(((x - k.pivots[pivot]) ** 2).sum(1))
                yield pa.record_batch([*own.columns, pa.array(pivot, pa.int32()), pa.array(far)], names=[*own.schema.names, "pivot", "far"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(dim: int, pivot: int, cell: int, part: pa.RecordBatch) -> pa.RecordBatch:
            one = lambda v: pa.ListArray.from_arrays([0, part.num_rows], v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v)
            vectors = pa.array([matrix(part.column("vector"), dim).astype("<f8").tobytes()], pa.binary())
            columns = [pa.array([dim], pa.int32()), pa.array([pivot], pa.int32()), pa.array([cell], pa.int64()), one(part.column("fid")), one(part.column("id")), one(part.column("label")), vectors]
            return pa.record_batch(columns, names=["dim", "pivot", "cell", "fids", "ids", "labels", "vectors"])

        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            rest = None
            dims, pivots = np.asarray(t["dim"]), np.asarray(t["pivot"])
            cells = np.floor(np.asarray(t["far"]) / np.array([keys[d].width for d in dims.tolist()])).astype(np.int64)
            edge = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (pivots[1:] != pivots[:-1]) | (cells[1:] != cells[:-1]), True])
            for lo, hi in zip(edge, edge[1:], strict=False):
                for a in range(lo, hi, BLOCK):
                    b = min(a + BLOCK, hi)
                    if b == t.num_rows and b - a < BLOCK:
                        rest = t.slice(a)
                    else:
                        yield block(int(dims[a]), int(pivots[a]), int(cells[a]), t.slice(a, b - a))
        if rest is not None and rest.num_rows:
            dim = rest["dim"][0].as_py()
            yield block(dim, rest["pivot"][0].as_py(), int(math.floor(rest["far"][0].as_py() / keys[dim].width)), rest)

    kinds = "fid bigint, id bigint, dim int, label string, vector array<bigint>"
    placed = table(rows.select("fid", "id", "dim", "label", "vector").mapInArrow(assign, f"{kinds}, pivot int, far double"), "placed")
    order = ["dim", "pivot", "far", "fid"]
    blocks = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "dim int, pivot int, cell bigint, fids array<bigint>, ids array<bigint>, labels array<string>, vectors binary")
    index = table(blocks.withColumn("block", F.monotonically_increasing_id()), "index")
    discard(placed)
    for r in index.groupBy("dim", "pivot").agg(F.min("cell").alias("a"), F.max("cell").alias("b")).collect():  # at most 256 a length
        keys[r["dim"]].first[r["pivot"]], keys[r["dim"]].last[r["pivot"]] = r["a"], r["b"]
    return index


def _radius(q: np.ndarray, most: float, score: np.ndarray) -> np.ndarray:
    """Distance of a lifted row with this inner product."""
    return np.sqrt(np.maximum((q * q).sum(-1) + most - 2 * np.maximum(score, -(2.0**52)), 0))


def search(index: DataFrame, keys: dict[int, Keys], asks: DataFrame, k: int) -> DataFrame:
    """(fid, slot, place, found, id, score): the best rows of each slot of each ask, from 1.

    asks has the columns of _ASK: a slot takes the best ``k`` rows, with the ask's label
    (``same``) or with another, whose score is between lo and hi; ``self`` never.
    """
    session = index.sparkSession
    held = session.sparkContext.broadcast(keys)
    directory = table(index.select("block", "dim", "pivot", "cell"), "directory")

    def annulus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each open ask and pivot the cells between the old and the new radius."""
        for batch in batches:
            for dim, own in _by_dim(batch):
                key = held.value[dim]
                q = matrix(own.column("vector"), dim)
                near = _distances(np.column_stack([q, np.zeros(len(q))]), key.pivots)
                was, now, inner = (np.asarray(own.column(c), dtype=np.float64)[:, None] for c in ("was", "radius", "inner"))
                cell = lambda far: np.floor(far / key.width)
                low = np.maximum(cell(np.maximum(near - now, inner - near) - key.slack()), key.first[None])
                high = np.minimum(cell(near + now + key.slack()), key.last[None])
                old_low, old_high = np.where(was < 0, np.inf, cell(near - was - key.slack())), np.where(was < 0, -np.inf, cell(near + was + key.slack()))
                parts = [(low, np.where(was < 0, high, np.minimum(high, old_low - 1))), (np.where(was < 0, np.inf, np.maximum(low, old_high + 1)), high)]
                fids = np.asarray(own.column("fid"))
                for a, b in parts:
                    i, p = np.nonzero(a <= b)
                    if len(i):
                        yield pa.record_batch([pa.array(fids[i]), pa.array(np.full(len(i), dim), pa.int32()), pa.array(p, pa.int32()), pa.array(a[i, p].astype(np.int64)), pa.array(b[i, p].astype(np.int64))], names=["fid", "dim", "pivot", "a", "b"])

    def scan(t: pa.Table) -> pa.Table:
        """One block and the asks that need it."""
        is_block = np.asarray(t["fids"].is_valid())
        block, asked = t.filter(pa.array(is_block)), t.filter(pa.array(~is_block))
        out: list[tuple[int, int, int, int, int]] = []
        if block.num_rows and asked.num_rows:
            dim = block["dim"][0].as_py()
            raw = block["vectors"][0].as_py()
            x = (np.frombuffer(raw, dtype="<f8") if raw else np.zeros(0)).reshape(-1 if dim else len(block["fids"][0]), dim)
            ids = np.array([LAST if v is None else v for v in block["ids"][0].as_py()], dtype=np.int64)
            fids = np.asarray(block["fids"][0].as_py(), dtype=np.int64)
            order = np.lexsort([fids, ids])  # a stable sort by score then settles ties
            x, ids, fids, labels = x[order], ids[order], fids[order], np.asarray(block["labels"][0].as_py(), dtype=object)[order]
            slots, same, own_label, own = asked["slots"].to_pylist(), asked["same"].to_pylist(), asked["label"].to_pylist(), asked["self"].to_pylist()
            names = asked["fid"].to_pylist()
            for lo in range(0, asked.num_rows, 256):
                q = matrix(asked["vector"].slice(lo, 256), dim)
                scores = np.rint(q @ x.T).astype(np.int64)
                for i in range(len(q)):
                    n = lo + i
                    fits = np.flatnonzero((labels == own_label[n]) == same[n])
                    fits = fits[fids[fits] != own[n]]
                    fits = fits[np.argsort(-scores[i, fits], kind="stable")]
                    down = -scores[i, fits]
                    for s, slot in enumerate(slots[n]):
                        a = int(np.searchsorted(down, -slot["hi"], side="left"))
                        b = min(a + k, int(np.searchsorted(down, -slot["lo"], side="right")))
                        out.extend((names[n], s, int(fids[j]), int(ids[j]), int(scores[i, j])) for j in fits[a:b])
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(["fid", "slot", "found", "id", "score"], columns, kinds, strict=True)})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The next radius of each ask, and its slots with what can still enter; -1 where all is certified."""
        for batch in batches:
            for dim, own in _by_dim(batch):
                key = held.value[dim]
                q = matrix(own.column("vector"), dim)
                utmost = np.sqrt((q * q).sum(1)) + math.sqrt(key.most)
                was, now = np.asarray(own.column("was")), np.asarray(own.column("radius"))
                after, fresh = np.empty(len(q)), []
                for i, (slots, found) in enumerate(zip(own.column("slots").to_pylist(), own.column("got").to_pylist(), strict=True)):
                    need = -1.0
                    have = {f["slot"]: f for f in found or ()}
                    for s, slot in enumerate(slots):
                        f = have.get(s)
                        if f is not None and f["n"] >= k:
                            slot["lo"] = max(slot["lo"], f["least"])
                        if slot["lo"] <= slot["hi"]:
                            need = max(need, min(float(_radius(q[i], key.most, np.array(float(slot["lo"])))), float(utmost[i])) + key.slack())
                    fresh.append(slots)
                    after[i] = -1 if need <= now[i] else (need / 2 if was[i] < 0 and need / 2 > now[i] else need)
                hi = np.array([max((s["hi"] for s in slots), default=LOWEST) for slots in fresh], dtype=np.float64)
                inner = np.maximum(_radius(q, key.most, np.minimum(hi, 2.0**52)) - key.slack(), 0)
                names = own.schema.names
                put = {"was": pa.array(now), "radius": pa.array(after), "inner": pa.array(inner), "slots": pa.array(fresh, own.schema.field("slots").type)}
                yield pa.record_batch([put.get(n, own.column(n)) for n in names if n != "got"], names=[n for n in names if n != "got"])

    state_kind = f"{_ASK}, was double, radius double, inner double"
    state = asks.withColumn("was", F.lit(-1.0)).withColumn("radius", F.lit(-1.0)).withColumn("inner", F.lit(0.0))
    nothing = F.lit(None).cast("array<struct<slot:int,n:int,least:bigint>>")
    state = table(state.withColumn("got", nothing).mapInArrow(_begin(judge), state_kind), "asks")
    found = None
    while state.where("radius >= 0").head(1):
        open_asks = state.where("radius >= 0")
        cells = open_asks.mapInArrow(annulus, "fid bigint, dim int, pivot int, a bigint, b bigint")
        cells = cells.select("fid", "dim", "pivot", F.explode(F.sequence("a", "b")).alias("cell"))
        meets = table(cells.join(directory, ["dim", "pivot", "cell"]).select("fid", "block"), "meets")
        packs = meets.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("packs"))
        blocks = index.join(packs, "block").withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1)))
        queries = meets.join(packs, "block").select("fid", "block", F.pmod(F.xxhash64("fid"), F.col("packs")).alias("pack")).join(open_asks.select("fid", "label", "vector", "self", "slots", "same"), "fid")
        both = blocks.select("block", "pack", "dim", "fids", "ids", "labels", "vectors").unionByName(queries, allowMissingColumns=True)
        hits = both.groupBy("block", "pack").applyInArrow(scan, "fid bigint, slot int, found bigint, id bigint, score bigint")
        if found is not None:
            hits = hits.unionByName(found.select("fid", "slot", "found", "id", "score"))
        best = Window.partitionBy("fid", "slot").orderBy(F.desc("score"), "id", "found")
        before, found = found, table(hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k), "found")
        got = found.groupBy("fid", "slot").agg(F.count("*").cast("int").alias("n"), F.min("score").alias("least")).groupBy("fid").agg(F.collect_list(F.struct("slot", "n", "least")).alias("got"))
        last = state
        state = table(open_asks.join(got, "fid", "left").mapInArrow(judge, state_kind), "asks")
        discard(meets, last, *([] if before is None else [before]))
    discard(state, directory)
    if found is None:
        return asks.select("fid", F.lit(0).alias("slot"), F.lit(0).alias("place"), F.col("fid").alias("found"), F.col("fid").alias("id"), F.lit(0).cast("long").alias("score")).where("false")
    return found.select("fid", "slot", "place", "found", "id", "score")


def _begin(judge):
    """Before the first round: radius 0, that is each query's own cell, where a slot can hold anything."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in judge(batches):
            radius = np.asarray(batch.column("radius"))
            put = {"was": pa.array(np.full(len(radius), -1.0)), "radius": pa.array(np.where(radius < 0, -1.0, 0.0))}
            yield pa.record_batch([put.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return first


def mine(df: DataFrame, *, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample: int = 32_768, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For each anchor and each of its best ``positives`` rows of its label: the best
    ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive.
    ``anchors`` is a condition on ``df``; other rows are searched as well.
    """
    vector = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & usable(F.col("v")))
    rows = table(rows.select(F.monotonically_increasing_id().alias("fid"), "id", "label", "anchor", whole(F.col("v")).alias("vector"), F.size("v").alias("dim")), "rows")
    first = Window.partitionBy("label", "vector").orderBy(F.col("id").asc_nulls_last(), "fid")
    kept = table(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max(KEEP, positives + 1, negatives)).drop("n"), "kept")
    keys = fitted(kept, sample)
    index = stored(kept, keys)

    def slot(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    asks = rows.where("anchor and id is not null").select("fid", "dim", "label", "vector", F.col("fid").alias("self"))
    near = table(search(index, keys, asks.withColumn("slots", F.array(slot(F.lit(LOWEST), F.lit(HIGHEST)))).withColumn("same", F.lit(True)), positives), "positives")
    bands = near.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("scores"))  # at most ``positives`` a row
    # whole numbers: low * p <= 100 * n <= high * p
    upper = lambda p: F.floor((p * high - F.pmod(p * high, F.lit(100))) / 100)
    lower = lambda p: F.floor((p * low + F.pmod(-p * low, F.lit(100))) / 100)
    slots = F.transform("scores", lambda p: slot(lower(p), upper(p)))
    far = search(index, keys, asks.join(bands.select("fid", slots.alias("slots")), "fid").withColumn("same", F.lit(False)), negatives)
    named = lambda c: F.when(F.col(c) != LAST, F.col(c))
    good = near.select("fid", (F.col("place") - 1).alias("slot"), named("id").alias("positive_id"), F.col("score").alias("positive_score"))
    bad = far.select("fid", "slot", F.col("place").alias("rank"), named("id").alias("negative_id"), F.col("score").alias("negative_score"))
    anchor = rows.where("anchor and id is not null").select("fid", F.col("id").alias("anchor_id"))
    return good.join(bad, ["fid", "slot"]).join(anchor, "fid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
