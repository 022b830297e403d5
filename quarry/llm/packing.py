"""Packing: first-fit decreasing over a tournament tree of bin capacities.

Every document becomes token ids ending in a separator.  Runs of exactly
``length`` ids are sequences by themselves; the rest of each document, shorter
than ``length``, goes to one of many randomised groups (a hash of its id), and
each group is packed alone: pieces in decreasing order, each into the first bin
with room, which a tournament tree over bin capacities finds in logarithmic
time.  Then the emptiest bins are dissolved: their pieces are cut to fill the
gaps of the others, so a group ends with at most one bin that is not full.

A group holds about ``group_docs`` documents at any input size; a third of all
rows under one source, one text or one id spreads like the others, as groups depend
on id and text together.  Rows that are equal in both meet in one group, whatever
their number: ids are taken to tell copies apart.  A null or empty text is the separator alone.  Equal lengths
are ordered by id; rows with equal ids, null ones included, are packed as separate
documents, told apart by ``start`` and order only.  Long texts are cut into whole
sequences first.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import chunks

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Bits of a sequence_id that number the bins of one group; those above number the group.
BIN_BITS = 24
#: Code points that both libraries split alike, shown by the tests for each one; texts with others take the slower library.
COMMON_BELOW = 0x250


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, ranks: str | None):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    if not ranks:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens=special)

    def encode(text: str) -> list[int]:
        if text.isascii() or ord(max(text)) < COMMON_BELOW:
            return fast.encode(text, allowed_special="all")
        return slow.encode(text, add_special_tokens=False).ids

    return encode


class CapacityTree:
    """A tournament tree: each inner node holds the largest free room below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.best = [room] * (2 * self.size)

    def place(self, need: int) -> int:
        """Put ``need`` into the first bin with that much room, and return the bin."""
        best, node = self.best, 1
        while node < self.size:
            node *= 2
            if best[node] < need:
                node += 1
        best[node] -= need
        found = node - self.size
        while node > 1:
            node //= 2
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left >= right else right
        return found


def first_fit_decreasing(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of indices into ``lengths`` (each at most ``room``), longest first."""
    order = np.argsort(-lengths, kind="stable")
    tree, bins = CapacityTree(len(lengths), room), []
    for k in order.tolist():
        b = tree.place(int(lengths[k]))
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def fill_gaps(lengths: np.ndarray, bins: list[list[int]], room: int) -> list[list[tuple[int, int, int]]]:
    """Cut the pieces of the emptiest bins into the gaps of the others: (index, from, to) per bin."""
    used = [int(lengths[b].sum()) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-used[k], k))
    out = [[(k, 0, int(lengths[k])) for k in bins[j]] for j in order]
    free = [room - used[j] for j in order]
    gap = 0
    while gap < len(out) - 1:
        if free[gap] == 0:
            gap += 1
            continue
        k, a, b = out[-1].pop()
        take = min(free[gap], b - a)
        out[gap].append((k, a, a + take))
        free[gap] -= take
        if a + take < b:
            out[-1].append((k, a + take, b))
        elif not out[-1]:
            out.pop()
            free.pop()
    return out


def pack(df: DataFrame, vocabulary: str, ranks: str | None = None, *, length: int = 1024, separator: int = 0, group_docs: int = 2000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is a tokenizers file; ``ranks``, where given, is the same
    vocabulary for the faster library, which is used for texts whose code points
    both libraries split alike.  Ids travel in 16 bits where the vocabulary allows it.
    """
    from tokenizers import Tokenizer

    wide = "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size(), separator + 1) <= 1 << 16 else "<u4"
    n = df.count()
    groups = max(1, -(-n // group_docs))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, ranks)
        for batch in chunks(batches, "text"):
            rows = []
            for doc, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.asarray([*(encoder(text) if text else ()), separator], dtype="<u4")
                whole = len(ids) // length * length
                for a in range(0, whole, length):
                    rows.append((doc, group, a, length, zlib.crc32(ids[a : a + length].tobytes()), len(ids), None))
                if whole < len(ids):
                    rows.append((doc, group, whole, len(ids) - whole, None, len(ids), ids[whole:].astype(wide).tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def pack_group(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["length"]))
        left, out, bins = [r for r in rows if r["rest"] is not None], [], 0
        for r in rows:
            if r["rest"] is None:
                out.append((r["doc_id"], r["start"], length, r["ids_crc32"], r["doc_tokens"], bins, 0))
                bins += 1
        lengths = np.asarray([r["length"] for r in left], dtype=np.int64)
        for b in fill_gaps(lengths, first_fit_decreasing(lengths, length), length):
            at = 0
            for k, a, z in b:
                r = left[k]
                ids = np.frombuffer(r["rest"], dtype=wide)[a:z].astype("<u4")
                out.append((r["doc_id"], r["start"] + a, z - a, zlib.crc32(ids.tobytes()), r["doc_tokens"], bins, at))
                at += z - a
            bins += 1
        first = rows[0]["group"] << BIN_BITS
        cols = list(zip(*(o[:5] + (o[5] + first, o[6]) for o in out), strict=True))
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(result, cols, strict=True)})

    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names = ["doc_id", "group", "start", "length", "ids_crc32", "doc_tokens", "rest"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    keyed = df.select(F.col(id_col).cast("long").alias("doc_id"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), F.lit(groups)).alias("group"), F.col(text_col).alias("text"))
    pieces = keyed.mapInArrow(encode, "doc_id bigint, group bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, rest binary")
    return pieces.groupBy("group").applyInArrow(pack_group, PIECE).withColumnRenamed("doc_id", id_col)
