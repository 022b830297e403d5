"""Substring dedup with compact windows: near-duplicate passages across documents.

Tokens are word shingles.  For each of ``hashes`` hash functions the Cartesian
tree of a document's token hashes gives compact windows (l, c, r): every
subsequence from [l, c] to [c, r] has its least hash at c, so one row stands for
all of them.  Only windows that hold a passage of ``least_words`` are kept.

1. exact copies of a text fold into their least id;
2. windows of equal value meet at up to two leaders of the value, the least
   document and one picked by hash: a linear number of rows however many share it;
   what steps 3 and 4 find makes classes of documents, and then all windows of
   equal value whose documents are in different classes meet, however many these
   are, unless their tokens rule a similar passage out;
3. for each pair of documents an interval join finds the widest passages that
   windows of at least ``agree`` hash functions allow on both sides;
4. those passages' tokens are fetched and trimmed to their first and last common
   token; what is not similar enough is cut at its long gaps of tokens that the
   other side lacks, and every piece with a Jaccard similarity of ``similarity``
   or more stays.

The result has one row per near-duplicate passage: the document with the larger
id, the passage's words, and those of the other document.  Exact copies give one
row with the whole text.  Documents without such a passage have no row.  Pairs in a
class are those with a representative; ``component_id``, the least document reachable
by rows, is the class in which the others of a group are found.

Very long texts are read whole; of equal hashes in a window the middle one counts.

Null, empty and short texts have no passage; rows of equal ids are never
compared; rows without an id are left out; extra columns are never read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._base import chunks, discard, mix, split_by_ids, table, word_hashes
from quarry.llm.components import components
from quarry.llm.ngramjoin import WORD


#: Stretches of one text that a row asks for.
ASKS = 500
#: Tokens of a batch of fetched stretches.
HELD = 1 << 20
#: Pairs of windows of a value in different classes, for each window, that are formed without a look at other tokens.
DIRECT = 32
#: Windows of a part of a key whose pairs are formed together.
PART = 4096


def tokens(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in order, offsets of each row's shingles, and each row's number of words."""
    words, count = word_hashes(column, WORD)
    each = np.maximum(count - n + 1, 0)
    first = np.cumsum(count) - count
    at = np.repeat(first, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    value = np.full(len(at), n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            value = mix(value * np.uint64(0x9FB21C651E98DF25) + words[at + k])
    return value, np.append(0, np.cumsum(each)), count


def _n_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words in place of each text."""
    for batch in chunks(batches, "text"):
        yield pa.record_batch([*batch.columns[:2], pa.array(word_hashes(batch.column(2), WORD)[1])], names=["id", "other", "w"])


def _keys(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens hashed with the number of their text."""
    row = np.repeat(np.arange(1, len(offsets), dtype=np.uint64), np.diff(offsets))
    return mix(value.view(np.uint64) ^ mix(row))


def _repeats(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places with those of equal tokens of a text together, and for each place where in that order its token's begin and end."""
    key = _keys(value, offsets)
    order = np.argsort(key)
    first = np.flatnonzero(np.append(len(key) > 0, key[order][1:] != key[order][:-1]))
    each = np.diff(np.append(first, len(value)))
    begin, end = np.empty(len(value), dtype=np.int64), np.empty(len(value), dtype=np.int64)
    begin[order], end[order] = np.repeat(first, each), np.repeat(first + each, each)
    return order, begin, end


def _least_of_stretches(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of each stretch of ``least`` tokens, and the first place that has it."""
    low, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < least:
        step = min(width, least - width)
        later = low[step:] < low[:-step]
        low, at = np.minimum(low[:-step], low[step:]), np.where(later, at[step:], at[:-step])
        width += step
    return low, at


def _nearest_less(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each value the last place before it in the same text with a lesser one, or -1."""
    back = np.arange(len(value)) - 1
    back[np.flatnonzero(text[1:] != text[:-1]) + 1] = -1
    left = np.flatnonzero(back >= 0)
    while len(left):
        left = left[value[back[left]] >= value[left]]
        back[left] = back[back[left]]
        left = left[back[left] >= 0]
    return back


def windows_of_texts(h: np.ndarray, offsets: np.ndarray, least: int, repeats: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Text, and (l, c, r) as places in ``h``, of the nodes of the Cartesian trees of the texts whose span [l, r] has ``least`` tokens; of equal hashes the middle one is the root.

    A node's hash is the least one of some stretch of ``least`` tokens, so runs of
    stretches with the same least hash are the nodes; their spans end where the next
    runs with a lesser one reach.
    """
    none = np.zeros(0, dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(h) < least:
        return none
    at = np.flatnonzero(row[: len(h) - least + 1] == row[least - 1 :])
    if not len(at):
        return none
    low, place = _least_of_stretches(h, least)
    low, place, row = low[at], place[at], row[at]
    first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])))
    value, text, place, begin, end = low[first], row[first], place[first], at[first], at[np.append(first[1:], len(at)) - 1]
    # a span begins behind the last token that is less, which the last lesser stretch has first; so for its end
    before, after = _nearest_less(value, text), len(value) - 1 - _nearest_less(value[::-1], text[::-1])[::-1]
    lo = np.where(before >= 0, end[before] + 1, offsets[text])
    hi = np.where(after < len(value), begin[np.minimum(after, len(value) - 1)] + least - 2, offsets[text + 1] - 1)
    order, of, to = repeats
    once = to[place] - of[place] == 1
    out, which = [], []
    for k in np.flatnonzero(~once)[np.unique(np.stack([lo[~once], hi[~once]]), axis=1, return_index=True)[1]].tolist():
        own = np.sort(order[of[place[k]] : to[place[k]]])
        stack = [(int(lo[k]), int(hi[k]), own[np.searchsorted(own, lo[k]) : np.searchsorted(own, hi[k], side="right")])]
        while stack:
            i, j, equal = stack.pop()
            if j - i + 1 < least or not len(equal):
                continue
            c = int(np.abs(equal - (i + j) / 2).argmin()) if len(equal) > 1 else 0
            out.append((i, int(equal[c]), j))
            which.append(text[k])
            stack += [(i, out[-1][1] - 1, equal[:c]), (out[-1][1] + 1, j, equal[c + 1 :])]
    spans = np.stack([lo[once], place[once], hi[once]], axis=1)
    return np.append(text[once], np.array(which, dtype=np.int64)), np.concatenate([spans, np.array(out, dtype=np.int64).reshape(-1, 3)])


def compact_windows(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of the windows of one text."""
    offsets = np.array([0, len(h)])
    repeats = _repeats(np.unique(h, return_inverse=True)[1].astype(np.uint64), offsets)
    return [tuple(w) for w in windows_of_texts(h, offsets, least, repeats)[1].tolist()]


def _windows(n: int, least: int, hashes: int):
    seeds = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            value, offsets, _ = tokens(batch.column(1), n)
            ids, repeats = np.asarray(batch.column(0)), _repeats(value, offsets)
            for f in range(hashes):
                h = mix(value ^ seeds[f])
                row, spans = windows_of_texts(h, offsets, least, repeats)
                found, spans = h.view(np.int64)[spans[:, 1]], (spans - offsets[row][:, None]).astype(np.int32)
                cols = [found, np.full(len(row), f, dtype=np.int8), ids[row], *(spans[:, c] for c in range(3))]
                yield pa.record_batch([pa.array(c) for c in cols], names=["value", "f", "id", "l", "c", "r"])

    return windows


def joint_passages(rows: list[tuple[int, ...]], agree: int, least: int) -> list[tuple[int, int, int, int]]:
    """Widest (from, to, other from, other to) that windows of ``agree`` hash functions allow together, and narrower ones that reach further on the other side.

    A row is (shift, f, l, c, r, other l, other c, other r) with shift = c - other
    c.  Collisions of one pair of passages lie near one diagonal, so rows are cut
    where the shift jumps; then a sweep over l keeps the windows that may begin there.
    """
    rows = sorted(set(rows))
    out: set[tuple[int, int, int, int]] = set()
    lo = 0
    for hi in range(1, len(rows) + 1):
        if hi < len(rows) and rows[hi][0] - rows[hi - 1][0] <= least // 2:
            continue
        part = sorted(rows[lo:hi], key=lambda w: w[2])
        lo = hi
        live: list[tuple[int, ...]] = []
        k = 0
        wide: list[tuple[int, int, int, int]] = []
        while k < len(part):
            i = part[k][2]
            live = [w for w in live if w[3] >= i]
            while k < len(part) and part[k][2] == i:
                live.append(part[k])
                k += 1
            reach: dict[int, int] = {}
            for w in live:
                if w[4] > reach.get(w[1], -1):
                    reach[w[1]] = w[4]
            if len(reach) < agree:
                continue
            j = sorted(reach.values())[-agree]
            if j - i + 1 < least:
                continue
            low: dict[int, int] = {}
            high: dict[int, int] = {}
            for _, f, _, c, r, ol, _, orr in live:
                if r >= j and c <= j:
                    low[f] = min(low.get(f, ol), ol)
                    high[f] = max(high.get(f, orr), orr)
            if len(low) < agree:
                continue
            a, b = sorted(low.values())[agree - 1], sorted(high.values())[-agree]
            wide = [p for p in wide if p[1] >= i]
            if b - a + 1 >= least and not any(j <= p[1] and p[2] <= a and b <= p[3] for p in wide):
                out.add((i, j, a, b))
                wide.append((i, j, a, b))
    return sorted(out)


def _whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by their first ``keys`` columns, dealt so that no key is in two deals."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [np.asarray(batch.column(k)) for k in range(keys)]
        cut = int(np.argmax(np.all([c == c[-1] for c in own], axis=0)))
        if held and (cut or [held[-1].column(k)[-1].as_py() for k in range(keys)] != [c[0] for c in own]):
            yield [*held, batch.slice(0, cut)]
            held = []
        elif cut:
            yield [batch.slice(0, cut)]
        held.append(batch.slice(cut))
    if held:
        yield held


def _join_intervals(agree: int, least: int):
    """Rows come sorted by pair of documents; a pair's rows, at most what its two texts have, are joined together."""
    names = ("id", "other", "f", "l", "c", "r", "ol", "oc", "or")

    def work(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        cols = [np.asarray(t[c], dtype=np.int64) for c in names]
        if len(cols[0]):  # most pairs met by fewer functions
            first = np.flatnonzero(np.append(True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)))
            met_by = np.bitwise_count(np.bitwise_or.reduceat(np.int64(1) << cols[2], first))
            enough = np.repeat(met_by >= agree, np.diff(np.append(first, len(cols[0]))))
            cols = [c[enough] for c in cols]
        if not len(cols[0]):
            return pa.record_batch([pa.array([], pa.int64())] * 6, names=["id", "other", "a", "b", "oa", "ob"])
        new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        rows = list(zip((cols[4] - cols[7]).tolist(), *(c.tolist() for c in cols[2:]), strict=True))
        out = []
        for a, z in zip([0, *new.tolist()], [*new.tolist(), len(rows)], strict=True):
            pair = int(cols[0][a]), int(cols[1][a])
            out += [(*pair, *p) for p in joint_passages(rows[a:z], agree, least)]
        found = list(zip(*out, strict=True)) or [()] * 6
        return pa.record_batch([pa.array(c, pa.int64()) for c in found], names=["id", "other", "a", "b", "oa", "ob"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(work, _whole(batches, 2))

    return join


def _fetch(n: int):
    """Tokens of the requested stretches of each text."""

    def rows(asked: list[tuple[int, int, int]], held: list[np.ndarray]) -> pa.RecordBatch:
        pair, side, at = zip(*asked, strict=True)
        ends = np.cumsum([0, *(len(t) for t in held)], dtype=np.int32)
        cols = [pa.array(pair, pa.int64()), pa.array(side, pa.int8()), pa.array(at, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(held))]
        return pa.record_batch(cols, names=["pair", "side", "at", "tokens"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            value, offsets, _ = tokens(batch.column(0), n)
            own, asked, held, size = value.view(np.int64), [], [], 0
            for k, asks in enumerate(batch.column(1).to_pylist()):
                text = own[int(offsets[k]) : int(offsets[k + 1])]
                for q in asks:
                    asked.append((q["pair"], q["side"], q["a"]))
                    held.append(text[q["a"] : q["b"] + 1])
                    size += len(held[-1])
                    if size >= HELD:
                        yield rows(asked, held)
                        asked, held, size = [], [], 0
            if asked:
                yield rows(asked, held)

    return fetch


def _numbered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both sides with their tokens numbered from 0, and how many tokens there are."""
    both, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
    return codes[: len(x)], codes[len(x) :], len(both)


def trimmed(x: np.ndarray, y: np.ndarray, least: int, similarity: float, size: int | None = None) -> tuple[int, int, int, int, float] | None:
    """(from, to, other from, other to, Jaccard) of the stretches between first and last common tokens, if similar enough.

    With ``size``, tokens are numbers below it.
    """
    if size is None:
        x, y, size = _numbered(x, y)
    nx, ny = np.bincount(x, minlength=size), np.bincount(y, minlength=size)
    ix, iy = np.flatnonzero(ny[x]), np.flatnonzero(nx[y])
    if not len(ix):
        return None
    a, b, c, d = int(ix[0]), int(ix[-1]), int(iy[0]), int(iy[-1])
    nx, ny = np.bincount(x[a : b + 1], minlength=size), np.bincount(y[c : d + 1], minlength=size)
    mine, theirs, both = np.count_nonzero(nx), np.count_nonzero(ny), np.count_nonzero((nx > 0) & (ny > 0))
    if b - a + 1 < least or d - c + 1 < least:
        return None
    if both / (mine + theirs - both) >= similarity:
        return a, b, c, d, both / (mine + theirs - both)
    # sides, counts within the stretches, distinct tokens, ends, and the common tokens next to the ends
    t, count, distinct = (x.tolist(), y.tolist()), (nx.tolist(), ny.tolist()), [int(mine), int(theirs)]
    first, last, after, before, both = [a, c], [b, d], [a + 1, c + 1], [b - 1, d - 1], int(both)

    def drop(s: int, at: int) -> None:
        count[s][t[s][at]] -= 1
        distinct[s] -= not count[s][t[s][at]]

    while first[0] < last[0] and first[1] < last[1]:
        gaps = []
        for s in (0, 1):
            shared = count[1 - s]
            while not shared[t[s][after[s]]]:
                after[s] += 1
            while not shared[t[s][before[s]]]:
                before[s] -= 1
            gaps += [(after[s] - first[s], 2 * s), (last[s] - before[s], 2 * s + 1)]
        # the end with the widest gap of tokens that the other side lacks goes first
        gap, end = max(gaps)
        if gap <= 1:
            return None
        s, o = end // 2, 1 - end // 2
        gone = t[s][last[s] if end % 2 else first[s]]
        if end % 2:
            for at in range(before[s] + 1, last[s] + 1):
                drop(s, at)
            last[s] = before[s]
            before[s] -= 1
        else:
            for at in range(first[s], after[s]):
                drop(s, at)
            first[s] = after[s]
            after[s] += 1
        if not count[s][gone]:
            both -= 1
            while first[o] <= last[o] and not count[s][t[o][first[o]]]:
                drop(o, first[o])
                first[o] += 1
            while first[o] <= last[o] and not count[s][t[o][last[o]]]:
                drop(o, last[o])
                last[o] -= 1
            after[o], before[o] = max(after[o], first[o] + 1), min(before[o], last[o] - 1)
        if last[0] - first[0] + 1 < least or last[1] - first[1] + 1 < least:
            return None
        jaccard = both / (distinct[0] + distinct[1] - both)
        if jaccard >= similarity:
            return first[0], last[0], first[1], last[1], jaccard
    return None


def _cuts(at: np.ndarray, part: np.ndarray, most: float) -> tuple[list[tuple[int, int]], int, int]:
    """Pieces of ``part`` between gaps of more than ``most`` different tokens, by the places of its common tokens, its widest gap and where that is."""
    gaps = at[1:] - at[:-1]
    if not len(gaps):
        return [(int(at[0]), int(at[-1]))], 1, 0
    widest = int(gaps.argmax())
    wide = [k for k in np.flatnonzero(gaps - 1 > most).tolist() if len(set(part[at[k] + 1 : at[k + 1]].tolist())) > most] if gaps[widest] - 1 > most else []
    edges = [0, *(k + 1 for k in wide), len(at)]
    return [(int(at[p]), int(at[q - 1])) for p, q in zip(edges, edges[1:])], int(gaps[widest]), widest


def _common(part: np.ndarray, other: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``part`` whose tokens ``other`` has, and which tokens these are."""
    marks = np.zeros(size, dtype=bool)
    marks[other] = True
    at = np.flatnonzero(marks[part])
    seen = np.zeros(size, dtype=bool)
    seen[part[at]] = True
    return at, seen


def _distinct(key: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, the number of each place's key among them, the fewest different ones that a stretch of ``least`` tokens of each text has (0 where a text is shorter), and which texts repeat one."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.append(len(key) > 0, ordered[1:] != ordered[:-1])[: len(key)]
    size = np.diff(offsets)
    few, repeats = np.where(size >= least, least, 0), np.zeros(len(size), dtype=bool)
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    again = np.flatnonzero(~new | np.append(~new[1:], False)) if len(key) else np.zeros(0, dtype=np.int64)
    if len(again):
        at, kind = order[again], number[order[again]]
        by = np.lexsort((at, kind))
        at, kind = at[by], kind[by]
        row = np.repeat(np.arange(len(size)), size)
        repeats[row[at]] = True
        # a repeated token is no new one in the stretches that hold its last place too, which is one token less for each
        then, last = at[1:][kind[1:] == kind[:-1]], at[:-1][kind[1:] == kind[:-1]]
        first = np.maximum(then - least + 1, offsets[row[then]])
        to = np.minimum(last, offsets[row[then] + 1] - least)
        counts = first <= to
        less = np.bincount(first[counts], minlength=len(key) + 1) - np.bincount(to[counts] + 1, minlength=len(key) + 1)
        held = size > 0
        few[held] = np.where(few[held] > 0, least - np.maximum.reduceat(np.cumsum(less)[:-1], offsets[:-1][held]), 0)
    return ordered[new], number, few, repeats


def _fewest_common(mine, theirs, similarity: float):
    """How many tokens a similar piece has in common at least, if its sides have so many different ones."""
    return np.maximum(similarity * np.maximum(mine, theirs), similarity / (1 + similarity) * (mine + theirs)) - 1e-9


def _dense(marks: np.ndarray, offsets: np.ndarray, least: int, share: float) -> np.ndarray:
    """Which texts have a stretch of ``least`` tokens or more whose share of marked ones is ``share``."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(row[: max(len(marks) - least + 1, 0)] == row[least - 1 :])
    beyond = np.append(0, np.cumsum(marks - share))
    # the least sum before a stretch's begin in its own text, as those of later texts are lower by more than any sum
    lower = row[at] * 2.0 * len(marks)
    before = np.minimum.accumulate(beyond[at] - lower) + lower
    return np.bincount(row[at[beyond[at + least] - before >= -1e-3]], minlength=len(offsets) - 1) > 0


def _in_order(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``own`` are in ``other``; both are in order."""
    at = np.searchsorted(other, own)
    return (at < len(other)) & (np.append(other, np.zeros(1, dtype=other.dtype))[at] == own)


def may_be_similar(x: np.ndarray, xo: np.ndarray, y: np.ndarray, yo: np.ndarray, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pair of texts can have a similar piece, and how many different tokens one has in common at least.

    All common tokens must suffice, and without repeated tokens a stretch of each
    side must have them in its share; the side with fewer different tokens has more.
    """
    offsets = xo, yo
    keys = [_distinct(_keys(t, o), o, least) for t, o in zip((x, y), offsets, strict=True)]
    shared = [_in_order(keys[k][0], keys[1 - k][0]) for k in (0, 1)]
    row = np.repeat(np.arange(len(xo) - 1), np.diff(xo))
    place = np.zeros(len(shared[0]), dtype=np.int64)
    place[keys[0][1]] = row
    fewest = _fewest_common(keys[0][2], keys[1][2], similarity)
    may = (keys[0][2] > 0) & (keys[1][2] > 0) & (np.bincount(place[shared[0]], minlength=len(xo) - 1) >= fewest)
    share = 2 * similarity / (1 + similarity)
    some, most = ([keys[k][3] | _dense(shared[k][keys[k][1]], offsets[k], least, part) for k in (0, 1)] for part in (similarity, share))
    return may & some[0] & some[1] & (most[0] | most[1]), fewest


def similar_pieces(x: np.ndarray, y: np.ndarray, least: int, similarity: float, fewest: float | None = None) -> list[tuple[int, int, int, int, float]]:
    """(from, to, other from, other to, Jaccard) of all pieces that are similar enough.

    What a piece leaves on either side is looked at again, and a stretch that is
    not similar is cut: at each gap that no similar passage can hold, since its
    tokens alone outweigh all common ones, else at its widest gap.  A piece has
    ``fewest`` different tokens in common at least.
    """
    if len(x) == len(y) >= least and (x == y).all():
        return [(0, len(x) - 1, 0, len(y) - 1, 1.0)]
    if fewest is None:
        fewest = may_be_similar(x, np.array([0, len(x)]), y, np.array([0, len(y)]), least, similarity)[1][0]
    x, y, size = _numbered(x, y)
    out: set[tuple[int, int, int, int, float]] = set()
    done: set[tuple[int, int, int, int]] = set()
    stack = [(0, len(x) - 1, 0, len(y) - 1)]
    while stack:
        i, j, a, b = stack.pop()
        if j - i + 1 < least or b - a + 1 < least or (i, j, a, b) in done:
            continue
        done.add((i, j, a, b))
        ix, seen = _common(x[i : j + 1], y[a : b + 1], size)
        if not len(ix) or ix[-1] - ix[0] + 1 < least or np.count_nonzero(seen) < fewest:
            continue
        iy = np.flatnonzero(seen[y[a : b + 1]])
        if iy[-1] - iy[0] + 1 < least:
            continue
        ix, iy = ix + i, iy + a
        i, j, a, b = int(ix[0]), int(ix[-1]), int(iy[0]), int(iy[-1])
        most = np.count_nonzero(seen) * (1 - similarity) / similarity + 1e-9
        (xs, gx, kx), (ys, gy, ky) = _cuts(ix, x, most), _cuts(iy, y, most)
        if len(xs) > 1 or len(ys) > 1:
            stack += [(*p, a, b) for p in xs] if len(xs) > 1 else [(i, j, *q) for q in ys]
            continue
        got = trimmed(x[i : j + 1], y[a : b + 1], least, similarity, size)
        if got:
            p, q, r, s = i + got[0], i + got[1], a + got[2], a + got[3]
            out.add((p, q, r, s, got[4]))
            stack += [(i, p - 1, a, b), (q + 1, j, a, b), (i, j, a, r - 1), (i, j, s + 1, b)]
        elif gx >= gy:
            stack += [(i, int(ix[kx]), a, b), (int(ix[kx + 1]), j, a, b)] if len(ix) > 1 else []
        else:
            stack += [(i, j, a, int(iy[ky])), (i, j, int(iy[ky + 1]), b)]
    return sorted(out)


def _verify(n: int, least: int, similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            mine, theirs = ((np.asarray(c.values), np.asarray(c.offsets, dtype=np.int64)) for c in batch.columns[4:])
            ends, lo = np.asarray(mine[1][1:] + theirs[1][1:]), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, mine[1][lo] + theirs[1][lo] + HELD, side="right")))
                cut = [(v[o[lo] : o[hi]], o[lo : hi + 1] - o[lo]) for v, o in (mine, theirs)]
                may, fewest = may_be_similar(*cut[0], *cut[1], least, similarity)
                for k in np.flatnonzero(may).tolist():
                    doc, other, at, oat = (c[lo + k].as_py() for c in batch.columns[:4])
                    x, y = (v[o[k] : o[k + 1]] for v, o in cut)
                    for a, b, c, d, jaccard in similar_pieces(x, y, least, similarity, fewest[k]):
                        rows.append((doc, other, at + a, at + b + n, oat + c, oat + d + n, jaccard))
                lo = hi
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 6 + [pa.float64()]
            names = ["id", "other", "start_word", "end_word", "other_start", "other_end", "similarity"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return verify


def _ordered(met: DataFrame) -> DataFrame:
    """Rows of f and two windows x and y, as columns of the window of the larger id and of the other."""
    mine = F.col("x.id") > F.col("y.id")
    met = met.select("f", F.when(mine, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(mine, F.col("y")).otherwise(F.col("x")).alias("y"))
    return met.select("f", F.col("x.id").alias("id"), F.col("y.id").alias("other"), "x.l", "x.c", "x.r", F.col("y.l").alias("ol"), F.col("y.c").alias("oc"), F.col("y.r").alias("or"))


def _with_leaders(shared: DataFrame) -> DataFrame:
    """Each window with a window of the least document of its value and one of a document picked by hash."""
    low, pick = (F.struct(*(F.col(f"{side}.{x}").alias(x) for x in ("id", "l", "c", "r"))) for side in ("low", "pick"))
    met = shared.select("f", F.struct("id", "l", "c", "r").alias("x"), F.explode(F.array_distinct(F.array(low, pick))).alias("y"))
    return _ordered(met.where("x.id <> y.id"))


def _supported(agree: int, least: int):
    """The windows that hold a passage with windows of ``agree`` - 1 other functions, and half of the values of those.

    Rows come sorted by id and c; all windows of a text are looked at together.
    """
    names = ("id", "c", "l", "r", "f", "value")

    def work(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        ids, c, l, r, f, value = (np.asarray(t[k]).astype(np.int64) for k in names)
        text = np.cumsum(np.append(0, np.diff(ids) != 0)) << 32
        lo, hi = np.searchsorted(text + c, text + l), np.searchsorted(text + c, text + r, side="right")
        ends, a = np.cumsum(hi - lo), 0
        while a < len(ids):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HELD, side="right")))
            each = (hi - lo)[a:z]
            w = np.repeat(np.arange(a, z), each)
            u = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo[a:z], each)
            fit = (l[u] <= c[w]) & (c[w] <= r[u]) & (f[u] != f[w]) & (np.minimum(r[u], r[w]) - np.maximum(l[u], l[w]) + 1 >= least)
            w, u = w[fit], u[fit]
            met_by = np.zeros(z - a, dtype=np.int64)
            np.bitwise_or.at(met_by, w - a, np.int64(1) << f[u])
            kept = np.bitwise_count(met_by) >= agree - 1
            w, u = w[kept[w - a]], u[kept[w - a]]
            near = np.bincount(w - a, minlength=z - a)[kept]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(near)).astype(np.int32)), pa.array((value[u] >> 32).astype(np.int32)))
            yield pa.record_batch([*t.slice(a, z - a).filter(pa.array(kept)).columns, lists], names=[*t.schema.names, "near"])
            a = z

    def supported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for deal in _whole(batches, 1):
            yield from work(deal)

    return supported


def _across(rows: DataFrame, keys: list[str]) -> DataFrame:
    """x and y: all pairs of windows (column w) of equal keys whose documents are in different classes.

    The windows outside the largest class of a key meet all windows of the key,
    which are dealt over parts.
    """
    own = rows.groupBy(*keys, "class").agg(F.count("*").alias("own"))
    groups = own.groupBy(*keys).agg(F.sum("own").alias("all"), F.max(F.struct("own", "class")).getField("class").alias("top"), F.count("*").alias("classes")).where("classes > 1")
    groups = groups.select(*keys, "top", F.ceil(F.col("all") / PART).alias("parts"))
    rows = rows.join(groups, keys)
    few = rows.where("class <> top").select(*keys, F.col("w").alias("x"), F.col("class").alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    every = rows.select(*keys, F.col("w").alias("y"), F.col("class").alias("theirs"), "top", F.pmod(F.xxhash64("w"), F.col("parts")).alias("part"))
    return few.join(every, [*keys, "part"]).where("mine <> theirs and (theirs = top or mine < theirs)")


def _spread(least: int, n: int, similarity: float):
    """Distinct tokens of each window, each hashed with the window's value, its class, and how many of them a similar passage around its least hash has in common with it at least."""

    def fewest(own: np.ndarray, lo: int, c: int, hi: int) -> int:
        """Distinct tokens that any passage around c has at least."""
        return min(len(np.unique(own[i : i + least])) for i in range(max(lo, c - least + 1), min(c, hi - least + 1) + 1))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            value, offsets, _ = tokens(batch.column(0), n)
            own, at, held, size = value.view(np.int64), [], [], 0

            def out() -> pa.RecordBatch:
                each = [len(t) for t in held]
                window, salt, own_class, common = (np.repeat(np.array(x, dtype=np.int64), each) for x in zip(*at, strict=True))
                keys = mix(np.concatenate(held).view(np.uint64) ^ mix(salt.view(np.uint64))).view(np.int64)
                return pa.record_batch([pa.array(window), pa.array(own_class), pa.array(common.astype(np.int32)), pa.array(keys)], names=["window", "class", "common", "token"])

            for k, asks in enumerate(batch.column(1).to_pylist()):
                text = own[int(offsets[k]) : int(offsets[k + 1])]
                for q in asks:
                    part = np.unique(text[q["l"] : q["r"] + 1])
                    distinct = least if len(part) == q["r"] - q["l"] + 1 else fewest(text, q["l"], q["c"], q["r"])
                    at.append((q["window"], q["value"], q["class"], int(np.ceil(similarity * distinct - 1e-9))))
                    held.append(part)
                    size += len(part)
                    if size >= HELD:
                        yield out()
                        at, held, size = [], [], 0
            if at:
                yield out()

    return spread


def _asked(texts: DataFrame, asks: DataFrame) -> DataFrame:
    """text and asks: the texts of ``asks`` (id and q) with their requests, in parts of bounded size, as a leader may be asked for by very many pairs."""
    touched, _ = split_by_ids(texts, asks.select("id").distinct(), "id")
    sizes = table(asks.groupBy("id").agg(F.ceil(F.count("*") / ASKS).alias("parts")), "sizes")  # a table, so that a hot leader's side of the join can be split
    parts = asks.join(sizes, "id").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts"))).groupBy("id", "part").agg(F.collect_list("q").alias("asks"))
    return touched.join(parts, "id").select("text", "asks")


def _unmet(shared: DataFrame, classes: DataFrame, texts: DataFrame, *, least: int, n: int, similarity: float, agree: int) -> DataFrame:
    """All pairs of windows of equal value that may hold a similar passage and whose documents are in different classes.

    Windows that windows of too few other functions support hold none, and pairs of
    windows must have as many supporting values in common.  Where a value has many
    pairs, which is where strangers share a line, only those are formed that also
    share a token which is not among the most frequent ones of the value: of the
    ``common`` tokens that two windows with a similar passage have in common, the
    rarest one cannot be among the ``common`` - 1 most frequent ones of either.
    """
    rows = shared.drop("low", "pick").join(classes.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
    groups = rows.groupBy("value").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select("value")
    rows = rows.join(groups, "value").select("id", "c", "l", "r", "f", "value", "class").repartition("id").sortWithinPartitions("id", "c")
    kept = table(rows.mapInArrow(_supported(agree, least), "id bigint, c int, l int, r int, f byte, value bigint, class bigint, near array<int>"), "kept")
    own = kept.groupBy("value", "class").agg(F.count("*").alias("own"))
    groups = own.groupBy("value").agg(F.sum("own").alias("all"), F.sum(F.col("own") * F.col("own")).alias("squares"), F.count("*").alias("classes")).where("classes > 1")
    groups = groups.select("value", ((F.col("all") * F.col("all") - F.col("squares")) / 2).alias("direct"), (F.col("all") * F.col("all") - F.col("squares") > 2 * DIRECT * F.col("all")).alias("many"))
    rows = table(kept.join(groups, "value").withColumn("window", F.monotonically_increasing_id()), "split")
    place, supported = F.struct("id", "l", "c", "r", "near"), F.expr(f"size(array_intersect(x.near, y.near)) >= {agree - 1}")
    few = rows.where("not many")
    many, found, used = rows.where("many"), None, [kept, rows]
    if many.head(1):
        asks = many.select("id", F.struct("window", "value", "class", "l", "c", "r").alias("q"))
        spread = _asked(texts, asks).mapInArrow(_spread(least, n, similarity), "window bigint, class bigint, common int, token bigint")
        # the same filters on both sides of the join below, so that both read one exchange
        spread = spread.where(" and ".join(f"{c} is not null" for c in ("window", "class", "common", "token"))).repartition("token")
        whole = F.struct("class", "window", "common")  # all columns, so that the exchange is the same on both sides
        often = spread.groupBy("token").agg(F.count("*").alias("times"), F.min(whole).alias("low"), F.max("class").alias("high")).where("low.class < high").select("token", "times")
        rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("times"), "token"))
        rare = table(spread.join(often, "token").withColumn("rank", rank).where("rank >= common").select("token", "class", F.col("window").alias("w")), "rare")
        used.append(rare)
        # copies of a text share so many tokens that forming all pairs of the value is less work
        each = rare.groupBy("token", "class").agg(F.count("*").alias("own"), F.min("w").alias("window")).groupBy("token").agg(F.sum("own").alias("all"), F.sum(F.col("own") * F.col("own")).alias("squares"), F.min("window").alias("window"))
        each = each.select("window", ((F.col("all") * F.col("all") - F.col("squares")) / 2).alias("by_token")).where("by_token > 0")
        dear = table(each.join(many.select("window", "value", "direct"), "window").groupBy("value", "direct").agg(F.sum("by_token").alias("by_token")).where("by_token > direct").select("value"), "dear")
        few = few.unionByName(many.join(dear, "value", "left_semi").select(*few.columns))
        many = many.join(dear, "value", "left_anti")
        rare = rare.join(many.select(F.col("window").alias("w")), "w", "left_semi")
        pairs = _across(rare, ["token"]).select("x", "y").distinct()
        x, y = (many.select(F.col("window").alias(side), "f", place.alias(f"w{side}")) for side in ("x", "y"))
        found = pairs.join(x, "x").join(y.drop("f"), "y").select("f", F.col("wx").alias("x"), F.col("wy").alias("y")).where(supported)
        used.append(dear)
    met = _across(few.select("value", "f", "class", place.alias("w")), ["value", "f"]).where(supported).select("f", "x", "y")
    if found is not None:
        met = met.unionByName(found)
    met = table(_ordered(met), "unmet")
    discard(*used)
    return met


def _verified(several: DataFrame, texts: DataFrame, *, least: int, n: int, similarity: float, agree: int) -> DataFrame:
    """The similar passages of the pairs of documents whose windows have met; where those are a table, it is deleted."""
    paired = several.select("id", "other", "f", "l", "c", "r", "ol", "oc", "or").repartition("id", "other").sortWithinPartitions("id", "other")
    spans = paired.mapInArrow(_join_intervals(agree, least), "id bigint, other bigint, a bigint, b bigint, oa bigint, ob bigint")
    spans = table(spans.withColumn("pair", F.monotonically_increasing_id()), "spans")

    asks = spans.select(F.col("id"), F.struct("pair", F.lit(0).cast("byte").alias("side"), "a", "b").alias("q")).unionByName(spans.select(F.col("other").alias("id"), F.struct("pair", F.lit(1).cast("byte").alias("side"), F.col("oa").alias("a"), F.col("ob").alias("b")).alias("q")))
    got = table(_asked(texts, asks).mapInArrow(_fetch(n), "pair bigint, side byte, at bigint, tokens array<bigint>"), "tokens")
    sides = [got.where(F.col("side") == s).select("pair", F.col("at").alias(f"at{s}"), F.col("tokens").alias(f"t{s}")) for s in (0, 1)]
    pairs = spans.select("id", "other", "pair").join(sides[0], "pair").join(sides[1], "pair").select("id", "other", "at0", "at1", "t0", "t1")
    schema = "id bigint, other bigint, start_word bigint, end_word bigint, other_start bigint, other_end bigint, similarity double"
    near = table(pairs.mapInArrow(_verify(n, least, similarity), schema).distinct(), "near")
    discard(several, spans, got)
    return near


def find(df: DataFrame, *, least_words: int = 50, n: int = 5, similarity: float = 0.8, hashes: int = 6, agree: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, other_doc_id, start_word, end_word, other_start, other_end (words, ends exclusive), similarity and component_id of each passage."""
    least = least_words - n + 1
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * least_words - 1))
    facts = table(rows.select("id", F.xxhash64("text").alias("key"), F.xxhash64("text", F.lit(1)).alias("key2")), "facts")
    reps = facts.groupBy("key", "key2").agg(F.min("id").alias("rep"), F.max("id").alias("most")).where("rep < most").drop("most")
    copies = table(facts.join(reps, ["key", "key2"]).where("id > rep").select("id", "key", "rep").distinct(), "copies")
    keyed = rows.withColumn("key", F.xxhash64("text"))
    maybe, single = split_by_ids(keyed, copies, "id")
    texts = single.unionByName(maybe.join(copies.select("id", "key"), ["id", "key"], "left_anti").select("id", "text", "key")).select("id", "text")

    windows = texts.mapInArrow(_windows(n, least, hashes), "value bigint, f byte, id bigint, l int, c int, r int")
    # what several documents hold, with the leaders of each value: one exchange and one sort for all of it
    same_value, place = Window.partitionBy("value"), F.struct("id", "l", "c", "r")
    several = windows.withColumn("first", F.min("id").over(same_value)).withColumn("last", F.max("id").over(same_value)).where("first < last").drop("first", "last")
    leaders = {"low": F.min(place).over(same_value), "pick": F.min(F.struct(F.xxhash64("id").alias("h"), "id", "l", "c", "r")).over(same_value)}
    shared = table(several.withColumns(leaders), "shared")
    steps = {"least": least, "n": n, "similarity": similarity, "agree": agree}
    near = _verified(_with_leaders(shared), texts, **steps)
    twins = copies.select("id", F.col("rep").alias("other"))
    classes = components(near.select("id", "other").unionByName(twins), "id", "other")
    left = _unmet(shared, classes, texts, **steps)
    discard(shared)
    if left.head(1):
        near = table(near.unionByName(_verified(left, texts, **steps)).distinct(), "near")
        classes = components(near.select("id", "other").unionByName(twins), "id", "other")
    same, _ = split_by_ids(keyed, copies, "id")
    zero = F.lit(0).cast("long")
    # counted by a step of its own, as a filter on words would be moved to before the join, where all texts are
    same = same.join(copies, ["id", "key"]).select("id", F.col("rep").alias("other"), "text").mapInArrow(_n_words, "id bigint, other bigint, w bigint").where(F.col("w") >= least_words).distinct()
    same = same.select("id", "other", zero.alias("start_word"), F.col("w").alias("end_word"), zero.alias("other_start"), F.col("w").alias("other_end"), F.lit(1.0).alias("similarity"))
    out = near.unionByName(same).join(classes.select(F.col("node").alias("id"), F.col("component").alias("component_id")), "id")
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("other", "other_doc_id")
