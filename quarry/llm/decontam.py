"""Benchmark decontamination over a distributed positional inverted index of training text.

1. The index is stored: training documents are read once, in blocks, and each
   block gives one row a term with the ascending positions of all its
   occurrences, and one row a document.  Only terms whose bit is set in a bitmap
   of the test terms (1 MB at any size) are stored; others can match nothing.
2. A window is a phrase of ``width`` consecutive item words (a shorter item is
   one window).  The index's own counts order its terms by how rare they are in
   the corpus; a window with a term that the corpus lacks goes.
3. Blocks form shards by hash.  A window goes to the shards that hold its rarest
   term, and meets the postings there, block by block: the rarest term's list,
   shifted by its offset, is intersected with the shifted lists of the others,
   next rarest first.  What is left are the exact occurrences.
4. With ``span``, the same lists answer windows whose words all occur, in any
   order, within a span of words: next to each posting of the rarest term, one
   of every other term must lie near.

A term of a third of all documents has one row in each block, so its postings
are spread over all shards; they are read as candidates only for windows that
have no rarer term.  Windows are dealt in parts of about ``part_windows`` by
their number, and each part meets every block: one plan for any benchmark.  The
test side stays distributed; the driver sees its bitmap and counts alone.

Null texts have no words; an item without words has no windows; repeated rows
are answered alike; equal windows of several items count for each of them, and
items with equal ids are one; long texts are read whole, in one block of their
own; an empty benchmark leaves every document clean, and an empty table gives
an empty result.  Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import CHUNK_BYTES, chunks, table, word_hashes

#: Digits, a-z and everything beyond ASCII; A-Z are lower-cased before.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: Bits of the bitmap of test terms: 1 MB.
TERM_BITS = 1 << 23
#: Bytes of stored postings that one shard should have.
SHARD_BYTES = 32 << 20
#: Candidates that are intersected at a time.
CANDIDATES = 2_000_000
#: What a stream of shard rows holds, in the order in which a block's rows must come.
WINDOW, DOCUMENTS, POSTINGS = 0, 1, 2
_NONE = np.zeros(0, dtype=np.int64)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the row of each, and the number of words of each row."""
    hashes, counts = word_hashes(column, WORD)
    return hashes.view(np.int64), np.repeat(np.arange(len(column)), counts), counts


def _item_windows(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            hashes, _, counts = words_of(batch.column(1))
            first = np.cumsum(counts) - counts
            rows, phrases = [], []
            for k, (a, n) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
                for at in range(a, a + max(1, n - width + 1) if n else a):
                    rows.append(k)
                    phrases.append(hashes[at : min(at + width, a + n)])
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(phrases, pa.list_(pa.int64()))], names=["item", "terms"])

    return cut


def item_windows(benchmark: DataFrame, width: int, item_id: str, item_text: str) -> DataFrame:
    """item (as a string) and terms: the word hashes of each different window of each item."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    return rows.mapInArrow(_item_windows(width), "item string, terms array<bigint>").distinct()


def term_bitmap(windows: DataFrame) -> np.ndarray:
    """Bits of the terms' low bits; its words reach the driver, at most 2**17 of them."""
    terms = windows.select(F.explode("terms").alias("t")).select(F.col("t").bitwiseAND(TERM_BITS - 1).alias("slot"))
    word, bit = F.shiftright("slot", 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("slot"), F.lit(64)).cast("int"))
    out = np.zeros(TERM_BITS // 64, dtype=np.int64)
    for at, bits in terms.groupBy(word.alias("at")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        out[at] = bits
    return out


def _index_blocks(bitmap: np.ndarray, gap: int):
    """Rows of the index; positions number the words of a block, with ``gap`` unused ones between documents."""
    names = ["block", "kind", "term", "n", "ordinal", "id", "n_words", "positions"]
    most = 2 * CHUNK_BYTES

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", most):
            hashes, row, counts = words_of(batch.column(1))
            slot = hashes & (TERM_BITS - 1)
            known = np.flatnonzero((bitmap[slot >> 6] >> (slot & 63)) & 1)
            order = known[np.argsort(hashes[known], kind="stable")]
            own, place = hashes[order], (order + row[order] * gap).astype("<i4")
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else _NONE
            ends = np.append(heads[1:], len(own)) if len(own) else _NONE
            raw, n, m = place.tobytes(), batch.num_rows, len(heads)
            first = (np.cumsum(counts) - counts + np.arange(n) * gap).astype("<i4")
            kinds = [DOCUMENTS] * (n + 1) + [POSTINGS] * m  # the documents, their first positions, the terms
            terms = pa.array([None] * (n + 1) + own[heads].tolist(), pa.int64())
            sizes = pa.array([None] * (n + 1) + (ends - heads).tolist(), pa.int64())
            ordinals = pa.array([*range(n), *[None] * (m + 1)], pa.int32())
            ids = pa.concat_arrays([batch.column(0), pa.nulls(m + 1, batch.column(0).type)])
            words = pa.array(counts.tolist() + [None] * (m + 1), pa.int64())
            lists = [None] * n + [first.tobytes()] + [raw[4 * a : 4 * z] for a, z in zip(heads.tolist(), ends.tolist(), strict=True)]
            block = pa.array(np.full(n + m + 1, at, dtype=np.int64))
            out = pa.record_batch([block, pa.array(kinds, pa.int8()), terms, sizes, ordinals, ids, words, pa.array(lists, pa.binary())], names=names)
            at += 1
            yield from (out.slice(k, 5000) for k in range(0, out.num_rows, 5000))

    return index


def build_index(df: DataFrame, bitmap: np.ndarray, gap: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: a row (block, ordinal, id, n_words) for each document, one with their first positions for each block, and a row (block, term, n, positions) for each term of a block."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"block bigint, kind byte, term bigint, n bigint, ordinal int, id {kind}, n_words bigint, positions binary"
    return table(rows.mapInArrow(_index_blocks(bitmap, gap), schema), "index")


class Postings:
    """The postings of one block: terms ascending, each with its ascending positions."""

    def __init__(self, terms: np.ndarray, lists: list[np.ndarray]):
        order = np.argsort(terms)
        self.terms = terms[order]
        self.size = np.asarray([len(x) for x in lists], dtype=np.int64)[order]
        self.starts = np.cumsum(self.size) - self.size
        self.positions = np.concatenate([lists[k] for k in order]).astype(np.int64) if len(order) else _NONE
        # one ascending list of (term's number, position) answers whether a term stands at a position
        self.keys = (np.repeat(np.arange(len(order)), self.size) << 32) + self.positions

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Each term's number, or -1 where the block lacks it."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def holds(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term has a position in [low, high]."""
        at = np.searchsorted(self.keys, (number << 32) + np.maximum(low, 0))
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (number << 32) + high)

    def candidates(self, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into ``number``, position) of all postings of the terms, some millions at a time."""
        count = self.size[number]
        ends, lo = np.cumsum(count), 0
        while lo < len(number):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, side="right")))
            which = np.repeat(np.arange(lo, hi), count[lo:hi])
            within = np.arange(len(which)) - np.repeat(ends[lo:hi] - count[lo:hi] - (ends[lo - 1] if lo else 0), count[lo:hi])
            yield which, self.positions[self.starts[number[which]] + within]
            lo = hi


class Windows:
    """Windows of a shard: terms rarest first, their offsets, and how many there are; rows are padded."""

    def __init__(self, names: list[int], terms: list[list[int]], offsets: list[list[int]]):
        self.names = np.asarray(names, dtype=np.int64)
        self.width = np.asarray([len(t) for t in terms], dtype=np.int64)
        most = int(self.width.max(initial=0))
        self.terms = np.asarray([t + [0] * (most - len(t)) for t in terms], dtype=np.int64).reshape(len(names), most)
        self.offsets = np.asarray([t + [0] * (most - len(t)) for t in offsets], dtype=np.int64).reshape(len(names), most)


def _numbered(post: Postings, test: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose terms the block all holds, and the numbers of their terms."""
    some, numbers = np.arange(len(test.names)), np.zeros_like(test.terms)
    for k in range(test.terms.shape[1]):
        numbers[some, k] = post.number(test.terms[some, k])
        some = some[(numbers[some, k] >= 0) | (test.width[some] <= k)]
    return some, numbers


def phrase_hits(post: Postings, test: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its first word) of every exact occurrence: the lists meet rarest first."""
    some, numbers = _numbered(post, test)
    found_w, found_at = [_NONE], [_NONE]
    for which, at in post.candidates(numbers[some, 0]) if len(some) else ():
        window = some[which]
        at = at - test.offsets[window, 0]
        for k in range(1, test.terms.shape[1]):
            place = at + test.offsets[window, k]
            keep = (test.width[window] <= k) | post.holds(numbers[window, k], place, place)
            window, at = window[keep], at[keep]
        found_w.append(window)
        found_at.append(at)
    return np.concatenate(found_w), np.concatenate(found_at)


def proximity_hits(post: Postings, test: Windows, span: int) -> list[tuple[int, int, int]]:
    """(window, first, last position) of least stretches of at most ``span`` words with all of a window's words in any order."""
    out = set()
    some, numbers = _numbered(post, test)
    for which, at in post.candidates(numbers[some, 0]) if len(some) else ():
        window = some[which]
        for k in range(1, test.terms.shape[1]):
            keep = (test.width[window] <= k) | post.holds(numbers[window, k], at - span + 1, at + span - 1)
            window, at = window[keep], at[keep]
        for w, p in zip(window.tolist(), at.tolist(), strict=True):
            need: dict[int, int] = {}
            for t in numbers[w, : test.width[w]].tolist():
                need[t] = need.get(t, 0) + 1
            near = []
            for t in need:
                own = post.positions[post.starts[t] : post.starts[t] + post.size[t]]
                near.append(own[np.searchsorted(own, p - span + 1) : np.searchsorted(own, p + span)])
            pool = np.sort(np.concatenate(near))
            for a in pool[pool <= p].tolist():
                got = [x[x >= a][:n] for x, n in zip(near, need.values(), strict=True)]
                if all(len(x) == n for x, n in zip(got, need.values(), strict=True)) and (last := max(int(x[-1]) for x in got)) - a < span and last >= p:
                    out.add((w, a, last))
    return sorted(out)


def _answers(test: Windows, found: np.ndarray, first: np.ndarray, near: bool) -> Iterator[tuple[int, bool, list[int], list[int]]]:
    """(ordinal, near, windows, covered words) of each document with matches (window, from, to)."""
    row = np.searchsorted(first, found[:, 1], side="right") - 1
    order = np.argsort(row, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(row[order]) != 0))
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        own = found[order[a:z]]
        r = int(row[order[a]])
        low, high = int(own[:, 1].min()), int(own[:, 2].max())
        edge = np.zeros(high - low + 2, dtype=np.int64)
        np.add.at(edge, own[:, 1] - low, 1)
        np.add.at(edge, own[:, 2] - low + 1, -1)
        covered = np.flatnonzero(np.cumsum(edge) > 0) + low - int(first[r])
        yield r, near, np.unique(test.names[own[:, 0]]).tolist(), covered.tolist()


def _match(span: int | None):
    """Rows come sorted by shard, part, and block, windows first; one block's postings are held at a time."""
    names = ["block", "ordinal", "near", "windows", "words"]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def answer(block: int, terms: list[int], lists: list[bytes], first: bytes, test: Windows) -> list[tuple]:
        if not terms or not len(test.names):
            return []
        post = Postings(np.asarray(terms, dtype=np.int64), [np.frombuffer(x, dtype="<i4") for x in lists])
        window, at = phrase_hits(post, test)
        starts = np.frombuffer(first, dtype="<i4")
        found = [(False, np.stack([window, at, at + test.width[window] - 1], axis=1))]
        if span is not None:
            found.append((True, np.asarray(proximity_hits(post, test, span), dtype=np.int64).reshape(-1, 3)))
        return [(block, *x) for near, f in found if len(f) for x in _answers(test, f, starts, near)]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, test = None, None, Windows([], [], [])
        named: tuple[list, list, list] = ([], [], [])
        terms: list[int] = []
        lists: list[bytes] = []
        first, out = b"", []
        for batch in batches:
            for shard, part, kind, at, term, more, offsets, positions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is not None and (at != block or (shard, part) != group):
                    out += answer(block, terms, lists, first, test)
                    block, terms, lists = None, [], []
                if (shard, part) != group:
                    group, named = (shard, part), ([], [], [])
                if kind == WINDOW:
                    for held, x in zip(named, (term, more, offsets), strict=True):
                        held.append(x)
                    continue
                if named is not None:
                    test, named = Windows(*named), None
                block = at
                if kind == DOCUMENTS:
                    first = positions
                else:
                    terms.append(term)
                    lists.append(positions)
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if block is not None:
            out = answer(block, terms, lists, first, test)
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return match


def find(df: DataFrame, benchmark: DataFrame, *, width: int = 10, part_windows: int = 1_000_000, span: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col``, n_words, n_hit, n_items, item_ids (sorted strings), and the hit words; with ``span`` also near_item_ids and near_words of the proximity matches."""
    held = table(item_windows(benchmark, width, item_id, item_text).withColumn("window", F.xxhash64("terms")), "windows")
    index = build_index(df, term_bitmap(held), max(width, span or 0) + 1, id_col=id_col, text_col=text_col)

    postings = index.where(F.col("kind") == POSTINGS)
    bytes_, blocks = postings.agg(F.coalesce(F.sum("n") * 4, F.lit(0)), F.count_distinct("block")).head()
    shards = max(1, min(blocks, -(-bytes_ // SHARD_BYTES)))
    shard = F.pmod(F.xxhash64("block"), F.lit(shards)).alias("shard")
    frequency = postings.groupBy("term").agg(F.sum("n").alias("frequency"))
    terms = held.select("window", F.posexplode("terms").alias("offset", "term")).distinct()
    sized = terms.join(frequency, "term", "left").groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "offset", "term"))).alias("by"))
    sized = table(sized.where("by[0].frequency > 0").select("window", F.col("by.term").alias("terms"), F.col("by.offset").cast("array<bigint>").alias("offsets")), "sized")
    parts = max(1, -(-sized.count() // part_windows))
    where = postings.select("term", shard).distinct()
    dealt = sized.withColumn("term", F.col("terms")[0]).join(where, "term").select("shard", F.pmod(F.xxhash64("window"), F.lit(parts)).alias("part"), F.lit(WINDOW).alias("kind"), F.lit(None).cast("long").alias("block"), F.col("window").alias("term"), "terms", "offsets", F.lit(None).cast("binary").alias("positions"))
    lists = index.where("positions is not null").select(shard, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.col("kind").cast("int").alias("kind"), "block", "term", F.lit(None).cast("array<bigint>").alias("terms"), F.lit(None).cast("array<bigint>").alias("offsets"), "positions")
    stream = dealt.unionByName(lists).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("block").asc_nulls_first(), "kind")
    hits = table(stream.mapInArrow(_match(span), "block bigint, ordinal int, near boolean, windows array<bigint>, words array<bigint>"), "hits")

    words = hits.groupBy("block", "ordinal", "near").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))
    named = hits.select("block", "ordinal", "near", F.explode("windows").alias("window")).join(held.select("window", "item"), "window")
    named = named.groupBy("block", "ordinal", "near").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = words.join(named, ["block", "ordinal", "near"])
    found = index.where("ordinal is not null").select("block", "ordinal", "id", "n_words")
    sides = [("", "item_ids", "hit_words"), ("near", "near_item_ids", "near_words")][: 2 if span is not None else 1]
    for near, items, hit in sides:
        found = found.join(both.where("near" if near else "not near").select("block", "ordinal", F.col("items").alias(items), F.col("words").alias(hit)), ["block", "ordinal"], "left")
    none_s, none_l = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    lists_ = [c for _, items, hit in sides for c in (F.coalesce(items, none_s).alias(items), F.coalesce(hit, none_l).alias(hit))]
    found = found.select(F.col("id").alias(id_col), "n_words", *lists_)
    return found.select(id_col, "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), *(c for _, items, hit in sides for c in (items, hit)))


def digest(item_ids: list[str]) -> str:
    return sha256(",".join(item_ids).encode()).hexdigest()
