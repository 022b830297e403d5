"""Shared helpers: shared-folder tables, Arrow batching, byte-level hashing.

Executors may be lost at any time, so intermediate results that are read more
than once are written as Parquet below ``spark.checkpoint.dir`` (shared by the
driver and all executors); nothing is kept in executor-local storage.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; longer single texts are taken alone.
CHUNK_BYTES = 1 << 20
#: Bytes of text whose words are hashed at a time, with some forty bytes of work for each.
HASH_BYTES = 1 << 18
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SCRATCH: dict[str, str] = {}
_PATHS: dict[int, tuple[weakref.ref, str]] = {}
_scope: contextvars.ContextVar[str] = contextvars.ContextVar("quarry_scope", default="tables")


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application below the cluster's shared checkpoint folder."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="quarry-ckpt-")
            spark.conf.set("spark.checkpoint.dir", base)
        _SCRATCH[app] = f"{base.rstrip('/')}/quarry-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_clean, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean(spark: SparkSession, root: str) -> None:
    try:
        _delete(spark, root)
    except Exception:  # the session may already be gone at exit; scratch is then left to the cluster's clean-up
        pass


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{_scope.get()}/{label}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``table`` that nothing to come reads, and let Spark drop the shuffle files of finished work."""
    for df in tables:
        ref, path = _PATHS.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            _delete(df.sparkSession, path)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scope(name: str):
    """Tables written inside belong to ``name`` and go with ``release``."""
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)


def release(spark: SparkSession, name: str) -> None:
    """Delete all tables of a scope; what was read from them must have been written by then."""
    _delete(spark, f"{scratch_root(spark)}/{name}")
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts cross to Python by the thousand, not ten thousand, unless the session says otherwise: that bounds a task's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that each slice holds about ``most`` bytes of ``column``."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < len(sizes):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the n + 1 offsets (null counts as empty)."""
    values = [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
    offsets = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return np.frombuffer(b"".join(values), dtype=np.uint8), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            seq = np.full(size, base, dtype=np.uint64)
            seq[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(seq)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any byte range."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): equal bytes give equal hashes."""
    _, down = _powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of each maximal run of word bytes; runs never cross documents."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] |= inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lower_az(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


def word_hashes(column: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column end to end, A-Z lower-cased, and each row's number of words."""
    hashes, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for part in chunks([pa.record_batch([column], names=["text"])], "text", HASH_BYTES):
        data, offsets = joined_bytes(part.column(0))
        data = lower_az(data)
        starts, ends, row = word_spans(data, offsets, is_word)
        hashes.append(span_hash(prefix_hash(data), starts, ends))
        counts.append(np.bincount(row, minlength=part.num_rows))
    return np.concatenate(hashes), np.concatenate(counts)


#: Bits of an id bitmap: 8 MB at any input size.
BITMAP_BITS = 1 << 26


def split_by_ids(df: DataFrame, ids: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``col`` may be in ``ids``, rows whose ``col`` surely is not).

    A bitmap of hashed ids of fixed size (at most 2**20 words of 64 bits) is
    broadcast, so the rows that an id table does not touch are never shuffled.
    With more ids than bits all rows may be in; joins that follow are exact.
    """
    slot = F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(BITMAP_BITS))
    word, bit = F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = table(ids.select(col).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits")), "bitmap")
    marked = df.withColumn("_slot_word", word).join(F.broadcast(words), F.col("_slot_word") == F.col("_word"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)
