"""N-gram Jaccard join with signature trees, exact for any skew.

A document is its set of distinct word shingles (hashed to 64 bits).  Equal sets
fold into one representative.  Two similar sets share a shingle in their
prefixes: the least ``n - ceil(t n) + 1`` of each under one fixed order that puts
shingles known to be frequent last.  Which ones are called frequent changes the
cost only, never the result.

First each representative is compared with one leader per band of two
min-hashes, a linear number of exact checks that joins near copies into parts
however many they are.  Then, for each shingle that prefixes of different parts
share, a signature tree is built: leaves are representatives by size, nodes hold
their OR-combined token bitmap and size range, and a dual traversal drops node
pairs whose greatest possible overlap is under what the threshold asks for, or
that lie in one part.  The trees of all groups that a task holds are walked
together, on packed bitmaps.  What is left is checked exactly on the whole sets,
and components of all links are the classes.

A shingle that many prefixes hold is split into blocks: rows of its largest
part's side meet the other rows block by block, so no task sees more than about
two blocks of one shingle.  No row is dropped.

Null, empty and wordless texts have no shingles and link with nothing; texts
shorter than ``n`` words are one shingle; repeated rows (equal ids too) link;
extra columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import chunks, discard, mix, split_by_ids, table, word_hashes
from quarry.llm.components import components

#: Everything but the space and the five ASCII control characters 9 to 13.
WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: A task reports shingles that it met in so many documents; the commonest of them, up to FREQUENT_MOST, are put last.
FREQUENT_IN_TASK = 4
FREQUENT_MOST = 1 << 20
BANDS = 4
#: Representatives of one shingle that a task compares at a time.
BLOCK = 4096
#: Node pairs that are bounded at a time.
FRONT = 1 << 15
MAP_BITS = 1024
#: Groups of so many rows are first thinned by counting shared keys of pairs.
SMALL = 8


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and the n + 1 offsets."""
    words, count = word_hashes(column, WORD)
    first = np.cumsum(count) - count
    hashes, owner = _runs(words, np.repeat(first, np.where(count >= n, count - n + 1, 0)), np.where(count >= n, count - n + 1, 0), n)
    for short in range(1, n):
        rows = np.flatnonzero(count == short)
        if len(rows):
            value = np.full(len(rows), short, dtype=np.uint64)
            for k in range(short):
                value = _chain(value, words[first[rows] + k])
            hashes, owner = np.concatenate([hashes, value]), np.concatenate([owner, rows])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(column) + 1))


def _chain(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(value * np.uint64(0x9FB21C651E98DF25) + word)


def _runs(words: np.ndarray, first: np.ndarray, each: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(each)), each)
    at = first + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    value = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        value = _chain(value, words[at + k])
    return value, owner


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def bitmap(hashes: np.ndarray) -> bytes:
    """A token bitmap of at least four bits a token where MAP_BITS allow, a power of two of bits.

    Long sets fill their map, which then bounds less; pairs of them go to the exact check.
    """
    bits = min(MAP_BITS, 1 << max(6, int(4 * len(hashes) - 1).bit_length()))
    out = np.zeros(bits, dtype=np.uint8)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


class SignatureTrees:
    """The signature trees of many groups, walked together: rows by segment (one side of a group), then size.

    A node of level k holds up to 2**k neighbours of one segment: their
    OR-combined bitmap, size range, range of map widths, most tokens that share a
    bit, and the part if there is one only.  Maps narrower than the widest are
    tiled: a token's bit is its hash modulo the width, so its tiles hold it.
    ``rest`` is how many tokens of a representative are not before the shared
    shingle in its order: where that is the first common one, no overlap is larger.
    """

    def __init__(self, segment: np.ndarray, sizes: np.ndarray, maps: list[bytes], parts: np.ndarray, rest: np.ndarray):
        order = self.order = np.lexsort((sizes, segment))
        width = np.asarray([len(m) for m in maps], dtype=np.int64)
        widest = int(width.max(initial=8))
        bits = np.zeros((len(maps), widest // 8), dtype="<u8")
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            raw = np.frombuffer(b"".join([maps[k] for k in own.tolist()]), dtype="<u8").reshape(len(own), -1)
            bits[own] = np.tile(raw, (1, widest // w))
        alike = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64) * width // widest
        count = np.bincount(segment)
        first = np.cumsum(count) - count
        node = [x[order] for x in (bits, sizes, sizes, width, width, alike, rest, np.unique(parts, return_inverse=True)[1])]
        self.levels, self.count, self.first = [node], [count], [first]
        while count.max(initial=0) > 1:
            half = (count + 1) // 2
            at = np.cumsum(half) - half
            own = np.repeat(np.arange(len(half)), half)
            k = 2 * (np.arange(len(own)) - at[own])
            a = first[own] + k
            b = a + (k + 1 < count[own])
            bits, low, high, thin, wide, alike, rest, part = node
            node = [bits[a] | bits[b], low[a], high[b], np.minimum(thin[a], thin[b]), np.maximum(wide[a], wide[b]), np.maximum(alike[a], alike[b]), np.maximum(rest[a], rest[b]), np.where(part[a] == part[b], part[a], -1)]
            count, first = half, at
            self.levels.append(node)
            self.count.append(count)
            self.first.append(first)

    def _possible(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs may hold a pair of different parts that reaches the threshold."""
        bits, low, high, thin, wide, alike, rest, part = self.levels[level]
        some = np.flatnonzero(((part[x] < 0) | (part[x] != part[y])) & (high[x] * 100 >= low[y] * percent) & (high[y] * 100 >= low[x] * percent))
        x, y = x[some], y[some]
        most = np.minimum(np.minimum(high[x], high[y]), np.minimum(rest[x], rest[y]))
        need = percent * (low[x] + low[y])
        held = np.flatnonzero(most * (100 + percent) >= need)
        some, x, y, most, need = some[held], x[held], y[held], most[held], need[held]
        # what may share a bit is known of the wider map; of maps of one width, the fuller bound holds
        equal = (thin[x] == wide[x]) & (thin[y] == wide[y]) & (thin[x] == thin[y])
        hidden = np.where(equal, np.minimum(alike[x], alike[y]), np.where(thin[x] > wide[y], alike[x], np.where(thin[y] > wide[x], alike[y], np.maximum(alike[x], alike[y]))))
        common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
        return some[np.minimum(common + hidden, most) * (100 + percent) >= need]

    def pairs(self, left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (into the constructor's arguments) of segments ``left[k]`` and ``right[k]`` that the bounds let through; a segment may meet itself."""
        top = np.zeros(len(left), dtype=np.int64)
        for count in self.count[:-1]:
            top += (count[left] > 1) | (count[right] > 1)
        stack = [(t, self.first[t][left[own]], self.first[t][right[own]]) for t in np.unique(top).tolist() for own in [np.flatnonzero(top == t)]]
        while stack:
            level, x, y = stack.pop()
            if len(x) > FRONT:
                stack += [(level, x[k : k + FRONT], y[k : k + FRONT]) for k in range(0, len(x), FRONT)]
                continue
            keep = self._possible(level, x, y, percent)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if not level:
                apart = x != y
                yield self.order[x[apart]], self.order[y[apart]]
                continue
            (a, more_a), (b, more_b) = self._below(level, x), self._below(level, y)
            same = x == y
            stack.append((level - 1, np.concatenate([a, a[more_b], a[more_a & ~same] + 1, a[more_a & more_b] + 1]), np.concatenate([b, b[more_b] + 1, b[more_a & ~same], b[more_a & more_b] + 1])))

    def _below(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first node below each, and whether the next one is below it too."""
        segment = np.searchsorted(self.first[level], node, side="right") - 1
        k = 2 * (node - self.first[level][segment])
        return self.first[level - 1][segment] + k, k + 1 < self.count[level - 1][segment]


def _frequent(rows: DataFrame, n: int) -> np.ndarray:
    """Shingles that single tasks met in several documents, commonest first, FREQUENT_MOST at most (8 MB)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        part, waiting = [], 0
        for batch in chunks(batches, "text"):
            part.append(shingle_sets(batch.column(1), n)[0])
            waiting += len(part[-1])
            if waiting > 500_000:
                held, sizes = _tally(held, sizes, part)
                part, waiting = [], 0
                if len(held) > 1_500_000:  # a summary: rare ones are let go, which changes the order only
                    keep = sizes > np.partition(sizes, len(sizes) // 2)[len(sizes) // 2]
                    held, sizes = held[keep], sizes[keep]
        held, sizes = _tally(held, sizes, part)
        keep = sizes >= FREQUENT_IN_TASK
        yield pa.record_batch([pa.array(held[keep].view(np.int64)), pa.array(sizes[keep])], names=["shingle", "n"])

    found = rows.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") >= 2 * FREQUENT_IN_TASK).orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST).select("shingle")
    out = np.sort(np.asarray([r[0] for r in top.toLocalIterator()], dtype=np.int64).view(np.uint64))
    return out


def _tally(held: np.ndarray, sizes: np.ndarray, part: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    fresh, counts = np.unique(np.concatenate(part), return_counts=True) if part else (held[:0], sizes[:0])
    both = np.concatenate([held, fresh])
    values, slot = np.unique(both, return_inverse=True)
    total = np.bincount(slot, weights=np.concatenate([sizes, counts]), minlength=len(values)).astype(np.int64)
    return values, total


def _profile(frequent, n: int, percent: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in chunks(batches, "text"):
            hashes, offsets = shingle_sets(batch.column(1), n)
            is_late = np.zeros(len(hashes), dtype=bool)
            if len(late) and len(hashes):
                is_late = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
            seeds = [mix(hashes ^ mix(np.asarray([k + 1], dtype=np.uint64))) for k in range(2 * BANDS)]
            rows = []
            for k in range(batch.num_rows):
                a, z = int(offsets[k]), int(offsets[k + 1])
                own, last = hashes[a:z], is_late[a:z]
                if a == z:
                    rows.append((0, 0, None, None, None, None, None))
                    continue
                p = int(prefix_length(np.int64(z - a), percent))
                key = np.concatenate([own[~last], own[last]])[:p]
                low = [int(s[a:z].min()) for s in seeds]
                bands = [(low[2 * b] * 31 + low[2 * b + 1] * 17 + b) % (1 << 63) for b in range(BANDS)]
                with np.errstate(over="ignore"):
                    d1, d2 = int(mix(own).sum(dtype=np.uint64) >> np.uint64(1)), int(np.bitwise_xor.reduce(mix(own ^ np.uint64(0xA5A5A5A5))) >> np.uint64(1))
                rows.append((z - a, int((~last).sum()), d1, d2, bands, key.view(np.int64), bitmap(own)))
            cols = list(zip(*rows, strict=True))
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "n_shingles", "n_rare", "d1", "d2", "bands", "keys", "bits"])

    return profile


def _shingles(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            hashes, offsets = shingle_sets(batch.column(1), n)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))], names=["id", "shingles"])

    return sets


def _tree_pairs(percent: int):
    """Candidate pairs of each group of rows (grp, side, rep, part, at, n, bits), which come sorted by group and side."""

    def emit(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        grp = np.asarray(t["grp"].combine_chunks().dictionary_encode().indices)
        side, rep, part, at, sizes = (np.asarray(t[c], dtype=np.int64) for c in ("side", "rep", "part", "at", "n"))
        new = np.flatnonzero(np.append(True, (np.diff(grp) != 0) | (np.diff(side) != 0)))
        segment = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(grp))))
        left = np.flatnonzero(side[new] == 0)
        after = np.minimum(left + 1, len(new) - 1)
        right = np.where(grp[new[after]] == grp[new[left]], after, left)
        trees = SignatureTrees(segment, sizes, t["bits"].to_pylist(), part, sizes - at)
        found = [(rep[x], rep[y]) for x, y in trees.pairs(left, right, percent)]
        x, y = (np.concatenate([f[k] for f in found] or [rep[:0]]) for k in (0, 1))
        apart = x != y
        return pa.record_batch([pa.array(np.minimum(x, y)[apart]), pa.array(np.maximum(x, y)[apart])], names=["a", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            grp = batch.column(0).to_pylist()
            if not grp:
                continue
            cut = len(grp)
            while cut and grp[cut - 1] == grp[-1]:
                cut -= 1
            if cut or (held and held[-1].column(0)[0].as_py() != grp[0]):
                if held and held[-1].column(0)[-1].as_py() != grp[0]:
                    yield emit(held)
                    held = []
                if cut:
                    yield emit([*held, batch.slice(0, cut)])
                    held = []
            held.append(batch.slice(cut))
        if held:
            yield emit(held)

    return pairs


def _checked(pairs: DataFrame, rows: DataFrame, n: int, percent: int, repeated: bool) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) whose whole shingle sets reach the threshold, and the table of sets; only texts in a pair are shuffled."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts, _ = split_by_ids(rows, ids, "id")
    sets = texts.mapInArrow(_shingles(n), "id bigint, shingles array<bigint>")
    if repeated:  # rows of equal id and text would multiply the pairs
        sets = sets.dropDuplicates(["id", "shingles"])
    sets = table(sets, "sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"), sets


def _promising(placed: DataFrame, percent: int) -> DataFrame:
    """Rows of large groups, and those of small groups whose document has a partner that shares enough of its prefix.

    Two sets of n and m tokens that share c tokens of their prefixes (p and q
    long) overlap in at most c + max(n - p, m - q): what comes after the prefix
    that ends first is all that is unknown.  Keys in large groups count as shared.
    """
    small, large = placed.where(F.col("n_rows") <= SMALL), placed.where(F.col("n_rows") > SMALL)
    cols = ["id", "own", "n", "part"]
    x, y = (small.select("key", *(F.col(c).alias(f"{c}_{s}") for c in cols)) for s in "ab")
    met = x.join(y, "key").where("id_a < id_b and part_a <> part_b and (own_a or own_b)")
    met = met.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    shared = met.groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count("*").alias("c"))
    more = large.groupBy("id").agg(F.count("*").alias("g"))
    shared = shared.join(more.select(F.col("id").alias("id_a"), F.col("g").alias("g_a")), "id_a", "left").join(more.select(F.col("id").alias("id_b"), F.col("g").alias("g_b")), "id_b", "left")
    after = lambda n: F.ceil(n * percent / 100) - 1  # noqa: E731  tokens beyond the prefix
    most = F.col("c") + F.least(F.coalesce("g_a", F.lit(0)), F.coalesce("g_b", F.lit(0))) + F.greatest(after(F.col("n_a")), after(F.col("n_b")))
    near = shared.where(most * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
    ids = near.select(F.col("id_a").alias("id")).union(near.select("id_b")).distinct()
    return large.unionByName(small.join(ids, "id", "left_semi").select(*small.columns)).select("key", "id", "at", "n", "part")


def join(df: DataFrame, *, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles and component_id (least id reachable by links) of each row; ids are integers.

    Rows without an id have no links and a null component.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(rows, n))
    schema = "id bigint, n_shingles bigint, n_rare bigint, d1 bigint, d2 bigint, bands array<bigint>, keys array<bigint>, bits binary"
    profiles = table(rows.mapInArrow(_profile(frequent, n, percent), schema), "profiles")
    sized = profiles.where("n_shingles > 0 and id is not null")
    reps = sized.groupBy("n_shingles", "d1", "d2").agg(F.min("id").alias("rep"))
    folded = table(profiles.select("id", "n_shingles", "d1", "d2").join(reps, ["n_shingles", "d1", "d2"], "left").select("id", "n_shingles", "rep"), "folded")
    # one row a representative; equal ids with different texts may each be one
    lead = table(sized.join(folded.where("id = rep").select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "n_shingles", "d1", "d2"]), "reps")

    # of near copies, the one with the fewest shingles of its own is nearest to all others
    banded = lead.select("id", "n_rare", F.explode("bands").alias("band")).repartition("band")
    leaders = banded.groupBy("band").agg(F.min(F.struct("n_rare", "id")).alias("low"), F.count("*").alias("n")).where("n > 1").select("band", F.col("low.id").alias("leader"))
    near = banded.join(leaders, "band").where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    near = table(near.distinct(), "near")

    keyed = lead.select("id", F.col("n_shingles").alias("n"), F.posexplode("keys").alias("at", "key")).repartition("key")  # one exchange for the counts and the join
    whole = F.struct("id", "at", "n")  # all columns, so that the exchange is the same on both sides
    shared = keyed.groupBy("key").agg(F.min(whole).alias("lo"), F.max("id").alias("hi")).where("lo.id < hi").select("key")
    keyed = table(keyed.join(shared, "key").select("key", "id", "at", "n"), "keyed")

    repeated = bool(profiles.groupBy("id").count().where("count > 1").head(1))
    checked, sets = _checked(near, rows, n, percent, repeated)
    first = table(checked, "first")
    discard(sets, near)
    parts = components(first)

    placed = keyed.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "at", "n", F.coalesce("component", "id").alias("part"))
    # similar sets differ in size by one step at most: each key is cut into groups of two neighbouring steps
    step = F.floor(F.log("n") / F.lit(max(-1.001 * math.log(percent / 100), 1e-6))).cast("long")
    both_steps = F.explode(F.array(*(F.struct(F.xxhash64("key", step + k).alias("key"), F.lit(k == 0).alias("own")) for k in (0, 1))))
    placed = placed.select("id", "at", "n", "part", both_steps.alias("g")).select("g.key", "g.own", "id", "at", "n", "part").repartition("key")
    groups = placed.groupBy("key").agg(F.count("*").alias("n_rows"), F.min(F.struct("part", "own", "id", "at", "n")).alias("p"), F.max("part").alias("q")).where("p.part < q").select("key", "n_rows")
    placed = table(placed.join(groups, "key"), "placed")
    placed = table(_promising(placed, percent), "promising")
    # each key's largest part is one side; keys of one part have nothing left to compare, and most keys with two
    # documents, whose sizes and places are known here, cannot reach the threshold
    at = F.struct("id", "at", "n")
    per_part = placed.groupBy("key", "part").agg(F.count("*").alias("rows"), F.min(at).alias("x"), F.max(at).alias("y"))
    sides = per_part.groupBy("key").agg(F.max(F.struct("rows", "part")).alias("top"), F.sum("rows").alias("n_rows"), F.count("*").alias("n_parts"), F.min("x").alias("x"), F.max("y").alias("y")).where("n_parts > 1")
    overlap = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    sides = sides.where((F.col("n_rows") > 2) | (overlap * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))))
    sides = sides.select("key", F.col("top.part").alias("main"), F.ceil(F.col("top.rows") / BLOCK).alias("main_blocks"), F.ceil((F.col("n_rows") - F.col("top.rows")) / BLOCK).alias("minor_blocks"))
    work = placed.join(sides, "key").withColumn("own", F.when(F.col("part") == F.col("main"), F.pmod(F.xxhash64("id"), "main_blocks")).otherwise(F.pmod(F.xxhash64("id"), "minor_blocks")))
    main, rest = F.col("part") == F.col("main"), F.col("minor_blocks")
    blocks = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    name = lambda tag, x, y: F.concat_ws("/", F.col("key").cast("string"), F.lit(tag), x.cast("string"), y.cast("string"))
    own = F.col("own")
    as_main = F.transform(blocks(rest), lambda j: F.struct(name("m", own, j).alias("grp"), F.lit(0).alias("side")))
    to_main = F.transform(blocks(F.col("main_blocks")), lambda i: F.struct(name("m", i, own).alias("grp"), F.lit(1).alias("side")))
    among = F.transform(blocks(rest), lambda j: F.struct(name("s", F.least(own, j), F.greatest(own, j)).alias("grp"), F.when(own <= j, 0).otherwise(1).alias("side")))
    spread = work.select("id", "part", "at", "n", F.explode(F.when(main, as_main).otherwise(F.concat(to_main, among))).alias("g"))
    signed = spread.join(lead.select("id", F.col("n_shingles").alias("n"), "bits"), ["id", "n"]).select("g.grp", "g.side", F.col("id").alias("rep"), "part", "at", "n", "bits")
    sorted_rows = signed.repartition("grp").sortWithinPartitions("grp", "side", "rep")
    more = table(sorted_rows.mapInArrow(_tree_pairs(percent), "a bigint, b bigint").distinct(), "more")
    discard(lead, placed, keyed)
    checked, sets = _checked(more, rows, n, percent, repeated)
    links = table(first.unionByName(checked), "links")
    discard(sets, more, first, profiles)

    # rows of one id whose texts differ are one node; the class of a set is that of its representative
    same_id = folded.where("rep is not null and id <> rep").groupBy("id", "rep").agg(F.lit(1).alias("x")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    classes = components(links.unionByName(same_id))
    out = folded.join(classes.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
