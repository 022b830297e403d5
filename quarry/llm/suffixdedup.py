"""Suffix-array dedup by bucket-pointer refinement, exact over whole texts.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Instead of one suffix array over the corpus, each
window of ``length`` bytes belongs to the bucket of its least hashed q-gram, so
equal windows always share a bucket, and neighbouring windows mostly do:

1. exact copies of a text are found by hash and taken out; they go whole;
2. documents name their buckets once per run of windows; buckets of a single
   document have nothing to give and are dropped;
3. what is left sends the text of its runs to the buckets.  There suffixes are
   refined: initial q-gram buckets get numbers, and suffixes are sorted by the
   bucket numbers at their own and at later offsets; new numbers replace the old
   ones and double the depth, here 8, 16, 32, until it is ``length``.  Suffixes of
   one final bucket are equal windows, and all but those of the least id are covered;
4. covered windows are joined to spans, and spans are cut from the texts.

A bucket with over ``HOT_BYTES`` of runs is not gathered: its windows are grouped
by their bytes with map-side minimums and joined back, which gives the same spans.

Null texts are empty.  Texts under ``length`` bytes keep all bytes.  Rows of
equal ids never remove each other's bytes; rows without an id neither remove nor
lose any.  Extra columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import chunks, joined_bytes, prefix_hash, span_hash, split_by_ids, table

#: Bytes of runs that one task gathers for a bucket; with what it then holds, some 300 MB.
HOT_BYTES = 4 << 20
#: Bytes of the first buckets' q-grams; shorter windows begin with themselves.
GRAM = 8
#: Bytes of bucket text that a task refines at a time.
REFINE_BYTES = 1 << 20
#: Bytes of text whose windows a task names at a time, with some hundred bytes of work for each.
NAME_BYTES = 1 << 19


def anchor_length(total_bytes: int, length: int) -> int:
    """q of the buckets: long enough that few q-grams meet by chance (two bits a byte of text), short enough for few buckets."""
    return max(8, min(length - 8, math.ceil((math.log2(max(total_bytes, 2)) + 10) / 2)))


def window_buckets(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one bucket: (bucket, row, first start, last start), starts within the joined bytes."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end_of = offsets[1:][row_of]
    at = np.arange(n - q + 1)
    hashes = (span_hash(prefix_hash(data), at, at + q) >> np.uint64(16)).view(np.int64)
    width, span, low = length - q + 1, 1, hashes
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    starts = np.flatnonzero(np.arange(n - length + 1) + length <= end_of[: n - length + 1])
    bucket, row = low[starts], row_of[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return bucket[first], row[first], starts[first], starts[last[: len(first)]]


def _numbers(keys: np.ndarray) -> np.ndarray:
    """Bucket numbers from 1 in the order of the keys; equal keys share one."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    del ranked
    out = np.empty(len(order), dtype=np.int32)
    out[order] = np.cumsum(fresh, dtype=np.int32)
    return out


def refine(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside the rows of the joined bytes, and their final bucket numbers: equal numbers, equal windows.

    Buckets begin as q-grams of at most 8 bytes.  Each round sorts the suffixes of
    every bucket that still holds several by the bucket numbers ``jump`` bytes
    later, and the next round reads the numbers that this one wrote.
    """
    room = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets)) - np.arange(len(data), dtype=np.int32)
    at = np.flatnonzero(room >= q).astype(np.int32)  # a task's bytes are far below 2**31
    gram = np.zeros(len(at), dtype=np.uint64)
    for k in range(q):
        gram <<= np.uint64(8)
        gram |= data[at + k]
    pointer = np.zeros(len(data), dtype=np.int32)
    pointer[at] = _numbers(gram)
    del gram
    depth = q
    while depth < length:
        jump = min(depth, length - depth)
        at = np.flatnonzero(room >= depth + jump).astype(np.int32)
        own = pointer[at]
        open_ = np.bincount(own)[own] > 1  # a bucket of one suffix is sorted already
        several = at[open_]
        fresh = _numbers(pointer[several].astype(np.int64) * (len(data) + 1) + pointer[several + jump])
        after = np.zeros(len(data), dtype=np.int32)
        after[several] = fresh
        alone = at[~open_]
        after[alone] = int(fresh.max(initial=0)) + 1 + np.arange(len(alone))
        pointer, depth = after, depth + jump
    starts = np.flatnonzero(room >= length)
    return starts, pointer[starts]


def covered_windows(docs: np.ndarray, texts: list[bytes], length: int, q: int) -> Iterator[tuple[int, int, int]]:
    """(row, first, end) of maximal runs of windows that a row with a smaller id also has; bytes [first, end)."""
    offsets = np.cumsum([0, *map(len, texts)])
    starts, bucket = refine(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets, length, q)
    row = np.searchsorted(offsets, starts, side="right") - 1
    least = np.full(int(bucket.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, bucket, docs[row])
    least = least[bucket]
    hit = np.flatnonzero(least < docs[row])
    if not len(hit):
        return
    cut = np.flatnonzero(np.append(True, (np.diff(starts[hit]) > 1) | (np.diff(row[hit]) != 0)))
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(hit)], strict=True):
        r = int(row[hit[a]])
        yield r, int(starts[hit[a]] - offsets[r]), int(starts[hit[z - 1]] - offsets[r]) + length


def _name(length: int, q: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", NAME_BYTES):
            data, offsets = joined_bytes(batch.column(1))
            bucket, row, first, last = window_buckets(data, offsets, length, q)
            ids = np.asarray(batch.column(0))
            yield pa.record_batch([pa.array(bucket), pa.array(ids[row], pa.int64()), pa.array((last - first + length).astype(np.int32))], names=["bucket", "id", "size"])

    return name


def _send(length: int, q: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", NAME_BYTES):
            data, offsets = joined_bytes(batch.column(2))
            bucket, row, first, last = window_buckets(data, offsets, length, q)
            wanted = batch.column(3).to_pylist()
            hot = [set(x or ()) for x in batch.column(4).to_pylist()]
            keep = np.zeros(len(bucket), dtype=bool)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for k, w in enumerate(wanted):
                keep[cuts[k] : cuts[k + 1]] = np.isin(bucket[cuts[k] : cuts[k + 1]], np.asarray(w, dtype=np.int64))
            bucket, row, first, last = bucket[keep], row[keep], first[keep], last[keep]
            raw = data.tobytes()
            yield pa.record_batch(
                [
                    pa.array(bucket, pa.int64()),
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.array(first - offsets[row], pa.int64()),
                    pa.array([raw[a : z + length] for a, z in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
                    pa.array([b in hot[r] for b, r in zip(bucket.tolist(), row.tolist(), strict=True)], pa.bool_()),
                ],
                names=["bucket", "id", "key", "start", "run", "hot"],
            )

    return send


def _cover(length: int, q: int, most: int):
    def work(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Of equal runs one is refined, for their least document; the others are covered whole."""
        t = pa.Table.from_batches(batches)
        docs, runs = np.asarray(t["id"]), t["run"].to_pylist()
        numbers: dict[bytes, int] = {}
        which = np.fromiter((numbers.setdefault(r, len(numbers)) for r in runs), dtype=np.int64, count=len(runs))
        texts = list(numbers)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, which, docs)
        bucket = np.zeros(len(texts), dtype=np.int64)
        bucket[which] = np.asarray(t["bucket"])  # equal runs share their bucket
        _, place, several = np.unique(bucket, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(several[place] > 1)
        parts: dict[int, list[tuple[int, int]]] = {}
        for r, a, z in covered_windows(least[mixed], [texts[k] for k in mixed.tolist()], length, q):
            parts.setdefault(int(mixed[r]), []).append((a, z))
        held = docs == least[which]
        whole = np.flatnonzero(~held)
        rows, first, end = [whole], [np.zeros(len(whole), dtype=np.int64)], [np.asarray([len(runs[r]) for r in whole.tolist()], dtype=np.int64)]
        for r in np.flatnonzero(held & np.isin(which, np.asarray(list(parts), dtype=np.int64))).tolist():
            spans = np.asarray(parts[int(which[r])])
            rows.append(np.full(len(spans), r))
            first.append(spans[:, 0])
            end.append(spans[:, 1])
        row, start = np.concatenate(rows), np.asarray(t["start"])
        take = pa.array(row, pa.int64())
        return pa.record_batch(
            [t["id"].take(take).combine_chunks(), t["key"].take(take).combine_chunks(), pa.array(start[row] + np.concatenate(first), pa.int64()), pa.array(start[row] + np.concatenate(end), pa.int64())],
            names=["id", "key", "start", "end"],
        )

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; work goes on once enough whole buckets are there."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in chunks(batches, "run", most):
            buckets = np.asarray(batch.column(0))
            cut = int(np.searchsorted(buckets, buckets[-1]))
            if size + batch.nbytes > most and held and (cut or buckets[0] != held[-1].column(0)[-1].as_py()):
                if cut:
                    held.append(batch.slice(0, cut))
                yield work(held)
                held, size = [], 0
                batch = batch.slice(cut) if cut else batch
            held.append(batch)
            size += batch.nbytes
        if held:
            yield work(held)

    return cover


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text, merged = text or b"", []
            for s in sorted(spans or (), key=lambda s: s["start"]):
                if merged and s["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["end"])
                else:
                    merged.append([s["start"], s["end"]])
            kept, at = [], 0
            for a, b in merged:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rest = b"".join(kept)
            rows.append((len(text), len(text) - len(rest), len(merged), sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in merged]))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup(df: DataFrame, *, length: int = 50, q: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes) of each row; ids are integers."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("key"), "text")
    facts = table(rows.select("id", "key", F.xxhash64("text", F.lit(1)).alias("key2"), F.octet_length("text").cast("long").alias("n_bytes")), "facts")
    total = facts.agg(F.sum("n_bytes")).head()[0] or 0
    anchor = anchor_length(total, length)
    q = min(q, GRAM, length)

    least = facts.groupBy("key", "key2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    copies = table(facts.join(least, ["key", "key2"]).where("id > least").select("id", "key").distinct(), "copies")
    maybe, single = split_by_ids(rows, copies, "id")
    rows = single.unionByName(maybe.join(copies, ["id", "key"], "left_anti").select("id", "key", "text"))

    long = rows.where((F.octet_length("text") >= length) & F.col("id").isNotNull())
    named = long.select("id", "text").mapInArrow(_name(length, anchor), "bucket bigint, id bigint, size int").repartition("bucket")
    shared = named.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("size").alias("n")).where("lo < hi").select("bucket", (F.col("n") > HOT_BYTES).alias("hot"))
    wanted = named.join(shared, "bucket").groupBy("id").agg(F.collect_set("bucket").alias("buckets"), F.collect_set(F.when(F.col("hot"), F.col("bucket"))).alias("hot_buckets"))
    wanted = table(wanted, "wanted")

    touched, _ = split_by_ids(long, wanted.select("id"), "id")
    sent = touched.join(wanted, "id").select("id", "key", "text", "buckets", "hot_buckets")
    sent = sent.mapInArrow(_send(length, anchor), "bucket bigint, id bigint, key bigint, start bigint, run binary, hot boolean")
    warm = sent.where("not hot").drop("hot").repartition("bucket").sortWithinPartitions("bucket")
    spans = warm.mapInArrow(_cover(length, q, REFINE_BYTES), "id bigint, key bigint, start bigint, end bigint")
    if wanted.where(F.size("hot_buckets") > 0).head(1):
        spans = spans.unionByName(_hot_spans(sent.where("hot"), length))
    spans = table(spans.groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")

    maybe, whole = split_by_ids(rows, spans.select("id"), "id")
    cut = maybe.join(spans, ["id", "key"], "left").select("id", "text", "spans")
    result = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"
    cut = cut.mapInArrow(_cut, result)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    zero = F.lit(0).cast("long")
    size = F.octet_length("text").cast("long")
    whole = whole.select("id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), none.alias("spans"))
    gone = F.col("n_bytes") >= length
    doubles = facts.join(copies, ["id", "key"], "left_semi").select(
        "id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        gone.cast("long").alias("n_spans"),
        F.when(gone, F.lit(sha256(b"").hexdigest())).alias("kept_sha256"),
        F.when(gone, F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("end")))).otherwise(none).alias("spans"),
    )
    short = doubles.where(~gone)
    tiny, _ = split_by_ids(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) < length).select("id", F.xxhash64("text").alias("key"), "text"), short.select("id"), "id")
    tiny = tiny.join(copies, ["id", "key"], "left_semi").select("id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), none.alias("spans"))
    return cut.unionByName(whole).unionByName(doubles.where(gone)).unionByName(tiny).withColumnRenamed("id", id_col)


def _hot_spans(runs: DataFrame, length: int) -> DataFrame:
    """Spans of buckets with very many runs, by the windows' bytes."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("run").cast("long") - length))
    windows = runs.select("id", "key", "start", "run", at.alias("k")).select("id", "key", (F.col("start") + F.col("k")).alias("start"), F.substring("run", F.col("k").cast("int") + 1, F.lit(length)).alias("window"))
    least = windows.groupBy("window").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("hi")
    return windows.join(least, "window").where("lo < id").select("id", "key", "start", (F.col("start") + length).alias("end"))
