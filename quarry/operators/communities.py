"""Louvain communities on DataFrames: local moves in blocks of nodes, then contraction, level after level.

A level's graph has both directions of each edge, (src, dst, w), a loop for what lies
inside a contracted node, and for each node its volume, the sum of its weights.  A node
wants the neighbouring community with the largest gain

    weight - resolution * volume of the node * volume of the community / total

where its own community counts without the node itself.

A level's nodes are dealt by hash into blocks of about BLOCK edges, packed once.  In a round a block gets the community of each node that it touches, and
the volumes of these: slices of the nodes answer with an array for each block, so that neither
edges nor what blocks touch are shuffled as rows.
A task then moves its block's nodes batch after batch, each batch seeing what those before
it did, while other blocks' nodes seem to stand still.  In a round half of the blocks move, in
the next the other half, so that neighbours seldom swap; a lone node joins another lone one
only if it ranks below that by a hash of the round.  Blocks that move together do not see each
other's joiners; a round that lowers modularity is undone and the next lets fewer nodes move.
A level ends when no node wants to move, or rounds stop to gain; its communities become the
next level's nodes.

No task holds more than a block, the nodes that it touches, and no driver any.  A node with
more edges than a block is a hub and in none: its edges stay rows of joins whose other side
has one row a key, and sums are combined before each shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.scratch import cut, drop, numbered

#: A round gains if it adds more than this to the modularity; so many rounds without gain end a level.
LEAST_GAIN, PATIENCE = 5e-5, 3
#: Edges of a block, batches that its nodes move in, and how often a round goes through them; a lone block goes on until none moves, so often at most.
BLOCK, BATCHES, SWEEPS, MOST_SWEEPS = 1 << 21, 32, 2, 64


#: What a task answers for a slice of the nodes at once, in all blocks together.
ANSWERS = 1 << 21


@dataclass
class Level:
    nodes: DataFrame
    packed: DataFrame
    touched: DataFrame
    hubs: DataFrame | None
    blocks: int
    bits: int
    loops: float
    total: float
    resolution: float


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them (as numpy.unique, which takes longer)."""
    order = np.argsort(values)
    ordered = values[order]
    begin = _begins(ordered)
    at = np.empty(len(values), np.int32)
    at[order] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(values))))
    return ordered[begin], at


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as one row: all nodes that it touches, which of them are its own, their ids and volumes, where the edges of these begin, their other ends by place, and weights unless all are 1."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    src, dst = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in range(2))
    w = np.concatenate([np.asarray(b.column(2)) for b in held]) if held[0].num_columns > 2 else None
    del held
    order = np.argsort(src)
    src, dst, w = src[order], dst[order], None if w is None else w[order]
    plain = src != dst
    first = _begins(src)
    names = src[first]
    volume = np.diff(np.append(first, len(src))).astype(np.float64) if w is None else np.add.reduceat(w, first)
    kept = np.add.reduceat(plain, first, dtype=np.int64)
    if not kept.any():
        return
    src, dst, w = src[plain], dst[plain], None if w is None else w[plain]
    own, volume, first = names[kept > 0], volume[kept > 0], np.append(0, np.cumsum(kept[kept > 0]))
    ids, at = _places(np.concatenate([own, dst]))
    cols = [ids, at[: len(own)], own, volume, first, at[len(own) :], np.zeros(0) if w is None or (w == 1).all() else w]
    yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=["block", "ids", *PACKED])


#: A block's arrays and their types.
PACKED = {"own": np.int32, "own_ids": np.int64, "own_volumes": np.float64, "first": np.int64, "near": np.int32, "w": np.float64}


def _touched(bits: int):
    """(part, block, at): the nodes that a block touches in each slice of 2**bits ids, by their place in it."""

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                parts = ids >> bits
                start = _begins(parts)
                parts = parts[start]
                at = [x.tobytes() for x in np.split((ids & ((1 << bits) - 1)).astype(np.uint16), start[1:])]
                yield pa.record_batch([pa.array(parts), pa.array(np.full(len(parts), block, np.int32)), pa.array(at, pa.binary())], names=["part", "block", "at"])

    return touched


def _answer(bits: int, types: dict[str, type]):
    """(part, block, ...): what is known of the nodes that each block touches in a slice, an array a column."""

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        place = np.zeros(1 << bits, np.int32)
        place[np.asarray(known["id"]) & ((1 << bits) - 1)] = np.arange(known.num_rows)
        wanted = [place[np.frombuffer(x.as_buffer(), np.uint16)] for x in asked["at"]]
        cols = {c: np.asarray(known[c]).astype(t) for c, t in types.items()}
        return pa.table({"part": asked["part"], "block": asked["block"], **{c: pa.array([col[x].tobytes() for x in wanted], pa.binary()) for c, col in cols.items()}})

    return answer


def _unpack(packed: pa.Table, known: pa.Table, types: dict[str, type]):
    """A block's arrays, and what is known of the nodes that it touches, in the order of their ids."""
    arrays = {c: np.frombuffer(packed[c][0].as_buffer(), t) for c, t in PACKED.items()}
    order = np.argsort(np.asarray(known["part"]))
    return arrays, {c: np.concatenate([np.frombuffer(known[c][k].as_buffer(), t) for k in order.tolist()]) for c, t in types.items()}


#: What a round and a contraction ask of the nodes.
STATE, OWN = {"own": np.int64, "own_volume": np.float64, "members": np.int32}, {"own": np.int64}


#: What a round gives for a node.
MOVED = {"id": pa.int64(), "own": pa.int64(), "was": pa.int64(), "volume": pa.float64(), "own_volume": pa.float64(), "inner": pa.float64()}


def _move(scale: float, least: float, alone: bool, share: float, turn: int, still: set[int]):
    """A row of MOVED for each of a block's nodes: where it goes, the community that it came from, and its weight into that; ``scale`` is resolution / total, blocks in ``still`` stay."""

    def move(packed: pa.Table, known: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return pa.schema(MOVED.items()).empty_table()
        block_of, of = _unpack(packed, known, STATE)
        own, ids, volume, first, near, w = (block_of[c] for c in PACKED)
        names, home = _places(of["own"])
        size, members = np.zeros(len(names)), np.zeros(len(names), np.int64)
        size[home], members[home] = of["own_volume"], of["members"]
        coin = (names.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        degree, was = np.diff(first), names[home[own]]
        same = home[near] == np.repeat(home[own], degree)
        inner = np.add.reduceat(w * same if len(w) else same, first[:-1], dtype=np.float64)  # every node of a block has an edge
        del same
        block = packed["block"][0].as_py()
        rng = np.random.default_rng([turn, block])
        for _ in range(0 if block in still else MOST_SWEEPS if alone else SWEEPS):
            moved = 0
            for batch in np.array_split(rng.permutation(len(own)), min(len(own), BATCHES)):
                count = degree[batch]
                row = np.repeat(np.arange(len(batch)), count)
                edge = np.repeat(first[batch] - np.cumsum(count) + count, count) + np.arange(len(row))
                key = row * len(names) + home[near[edge]]
                if len(w):
                    order = np.argsort(key)
                    key, weights = key[order], w[edge[order]]
                else:
                    key.sort()
                start = _begins(key)
                into = np.add.reduceat(weights, start) if len(w) else np.diff(np.append(start, len(key))).astype(np.float64)
                row, to = np.divmod(key[start], len(names))
                mine, own_volume = home[own[batch]], volume[batch]
                stay = to == mine[row]
                value = into - scale * own_volume[row] * size[to]
                here = -scale * own_volume * (size[mine] - own_volume)
                here[row[stay]] += into[stay]
                value[stay] = -np.inf
                begin = _begins(row)
                top = np.maximum.reduceat(value, begin)
                best = np.full(len(batch), len(names))
                np.minimum.at(best, row[value == top[row]], to[value == top[row]])  # ties go to the least community
                go = top - here > least
                if share < 1:
                    go &= rng.random(len(batch)) < share
                batch, mine, best, own_volume = batch[go], mine[go], best[go], own_volume[go]
                if not alone:
                    go = (members[mine] > 1) | (members[best] > 1) | (coin[mine] < coin[best])
                    batch, mine, best, own_volume = batch[go], mine[go], best[go], own_volume[go]
                for change, of_node in ((size, own_volume), (members, 1)):
                    np.subtract.at(change, mine, of_node)
                    np.add.at(change, best, of_node)
                home[own[batch]] = best
                moved += len(batch)
            if not moved:
                break
        return pa.table({"id": ids, "own": names[home[own]], "was": was, "volume": volume, "own_volume": of["own_volume"][own], "inner": inner})

    return move


def _merge(packed: pa.Table, known: pa.Table) -> pa.Table:
    """A block's edges between communities, summed; of an edge's two directions the one that does not fall."""
    if not packed.num_rows:
        return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
    block_of, of = _unpack(packed, known, OWN)
    own, _, _, first, near, w = (block_of[c] for c in PACKED)
    names, home = _places(of["own"])
    src, dst = np.repeat(home[own].astype(np.int64), np.diff(first)), home[near]
    rises = src <= dst
    key, w = src[rises] * len(names) + dst[rises], w[rises] if len(w) else w
    del src, dst, rises
    if len(w):
        order = np.argsort(key)
        key, w = key[order], w[order]
    else:
        key.sort()
    start = _begins(key)
    sums = np.add.reduceat(w, start) if len(w) else np.diff(np.append(start, len(key))).astype(np.float64)
    return pa.table({"src": names[key[start] // len(names)], "dst": names[key[start] % len(names)], "w": sums})


def _level(ways: DataFrame, total: float, resolution: float) -> Level:
    """The level of edges (src, dst, w) with loops, packed; without w, edges of weight 1."""
    plain, w = F.col("src") != F.col("dst"), F.col("w") if "w" in ways.columns else F.lit(1.0)
    per = ways.groupBy(F.col("src").alias("id")).agg(F.sum(w).alias("volume"), F.sum(F.when(plain, 0.0).otherwise(w)).alias("loop"), F.count_if(plain).alias("degree"))
    nodes = cut(per)
    row = nodes.agg(F.sum("degree").alias("edges"), F.coalesce(F.max("degree"), F.lit(0)).alias("most"), F.sum("loop").alias("loops")).head()
    edges, hubs = ways, None
    if row["most"] > BLOCK:
        large = nodes.where(F.col("degree") > BLOCK).select(F.col("id").alias("src"))  # fewer than there are blocks
        hubs, edges = cut(edges.where(plain).withColumn("w", w).join(F.broadcast(large), "src")), edges.join(F.broadcast(large), "src", "left_anti")
    blocks = max(1, -(-row["edges"] // BLOCK))
    bits = min(16, max(8, (ANSWERS // blocks).bit_length() - 1))
    dealt = edges.select("src", "dst", *(["w"] if "w" in ways.columns else [])).repartition(blocks, "src")
    packed = cut(dealt.mapInArrow(_pack, ", ".join(["block int", "ids binary", *(f"{c} binary" for c in PACKED)])))
    touched = cut(packed.select("block", "ids").mapInArrow(_touched(bits), "part bigint, block int, at binary"))
    return Level(nodes, packed, touched, hubs, blocks, bits, row["loops"], total, resolution)


def _in_blocks(level: Level, rows: DataFrame, types: dict[str, type], work, schema: str) -> DataFrame:
    """``work`` on each block and what is known of the nodes that it touches, which slices of the nodes answer in arrays."""
    schema_of = ", ".join(["part bigint", "block int", *(f"{c} binary" for c in types)])
    known = rows.select(F.shiftright("id", level.bits).alias("part"), "id", *types)
    answers = level.touched.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_answer(level.bits, types), schema_of)
    tasks = 2 * level.blocks  # hashes of few blocks deal them unevenly
    return level.packed.drop("ids").repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(work, schema)


def _hub_moves(level: Level, sized: DataFrame) -> DataFrame:
    """What ``_move`` gives, for hubs."""
    scale = level.resolution / level.total
    ends = sized.select(F.col("id").alias("dst"), F.col("own").alias("near"), F.col("own_volume").alias("near_volume"), F.col("coin").alias("near_coin"))
    near = level.hubs.join(ends, "dst").groupBy("src", "near").agg(F.sum("w").alias("w"), F.first("near_volume").alias("near_volume"), F.first("near_coin").alias("near_coin"))
    seen = near.join(sized.withColumnRenamed("id", "src"), "src")
    stay = F.col("near") == F.col("own")
    value = F.col("w") - scale * F.col("volume") * F.col("near_volume")
    best = F.max(F.when(~stay, F.struct(value.alias("value"), (-F.col("near")).alias("least"), "near_coin"))).alias("best")
    per = seen.groupBy(F.col("src").alias("id"), "own", "coin", "volume", "own_volume").agg(F.coalesce(F.sum(F.when(stay, F.col("w"))), F.lit(0.0)).alias("inner"), best)
    here = F.col("inner") - scale * F.col("volume") * (F.col("own_volume") - F.col("volume"))
    go = (F.col("best.value") - here > 1e-9 * level.total) & (F.col("coin") < F.col("best.near_coin"))
    return per.select("id", F.when(go, -F.col("best.least")).otherwise(F.col("own")).alias("own"), F.col("own").alias("was"), "volume", "own_volume", "inner")


def _round(level: Level, homes: DataFrame, turn: int, share: float) -> tuple[DataFrame, float, int]:
    """The homes (id, own, ...) after a round, the modularity of those before it, and how many nodes moved."""
    homes = homes.select("id", "own", "volume")
    sizes = homes.groupBy("own").agg(F.sum("volume").alias("own_volume"), F.count("*").alias("members"))
    sized = homes.join(sizes, "own").select("id", "own", "volume", "own_volume", "members")
    alone = level.blocks == 1 and level.hubs is None
    dealt = np.random.default_rng(turn // 2).permutation(level.blocks).tolist()
    half = level.blocks // 2
    still = set() if level.blocks == 1 else set(dealt[:half] if turn % 2 else dealt[half:])
    move = _move(level.resolution / level.total, 1e-9 * level.total, alone, share, turn, still)
    moves = _in_blocks(level, sized, STATE, move, "id bigint, own bigint, was bigint, volume double, own_volume double, inner double")
    if level.hubs is not None:
        moves = moves.unionByName(_hub_moves(level, sized.withColumn("coin", F.xxhash64("own", F.lit(turn)))))
    lone = level.nodes.where("degree = 0")  # in no block, and nobody's neighbours
    after = cut(moves.unionByName(lone.select("id", F.col("id").alias("own"), F.col("id").alias("was"), "volume", F.col("volume").alias("own_volume"), F.lit(0.0).alias("inner"))))
    inside = (F.sum("inner") + level.loops) / level.total
    spread = F.sum(F.col("volume") * F.col("own_volume")) * level.resolution / level.total**2
    row = after.agg((inside - spread).alias("q"), F.count_if(F.col("own") != F.col("was")).alias("n")).head()
    return after, row["q"], row["n"]


def _settle(level: Level) -> tuple[DataFrame, bool]:
    """The table of (id, own, ...) after the level's rounds, and whether any node moved for good."""
    homes, moved, idle, share, turn = level.nodes.withColumn("own", F.col("id")), False, 0, 1.0, 1
    after, top, n = _round(level, homes, turn, share)
    alone = level.blocks == 1 and level.hubs is None
    while idle < PATIENCE and (n or not alone):
        turn += 1
        if not n:  # none in this half
            drop(after)
            idle += 1
            after, _, n = _round(level, homes, turn, share)
            continue
        later, quality, more = _round(level, after, turn, share)
        if quality < top - 1e-12:  # too many joined at once: undo
            drop(after, later)
            share, idle = share / 2, idle + 1
            after, _, n = _round(level, homes, turn, share)
            continue
        idle = 0 if quality > top + LEAST_GAIN else idle + 1
        moved |= quality > top + 1e-12
        drop(homes)
        homes, top, after, n = after, quality, later, more
    drop(after)
    return homes, moved


def _contracted(level: Level, homes: DataFrame) -> DataFrame:
    """Edges between the communities, with what lies inside as loops."""
    own = homes.select("id", "own")
    loops = level.nodes.where("loop <> 0").join(own, "id").select(F.col("own").alias("src"), F.col("own").alias("dst"), F.col("loop").alias("w"))
    parts = _in_blocks(level, own, OWN, _merge, "src bigint, dst bigint, w double").unionByName(loops)
    if level.hubs is not None:
        a, b = own.select(F.col("id").alias("src"), F.col("own").alias("a")), own.select(F.col("id").alias("dst"), F.col("own").alias("b"))
        parts = parts.unionByName(level.hubs.join(a, "src").join(b, "dst").where("a <= b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"))
    once = cut(parts.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    ways = _both(once)
    ways.cut_path = once.cut_path
    return ways


def _both(once: DataFrame) -> DataFrame:
    """Both directions of edges (src, dst, ...), and loops once."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), *once.columns[2:])
    ends = F.when(F.col("src") == F.col("dst"), F.array(way("src", "dst"))).otherwise(F.array(way("src", "dst"), way("dst", "src")))
    return once.select(F.explode(ends).alias("e")).select("e.*")


def communities(nodes: DataFrame, edges: DataFrame, *, resolution: float = 1.0, in_order: bool = False) -> DataFrame:
    """(id, community) of nodes (id, ord) and undirected edges (src, dst), numbered by the order of each community's first node; a node without edges is alone.

    Rows of equal ids are one node and get a row each.  With ``in_order`` ids are whole numbers that are
    not negative and rise with ``ord``, all ends of edges are among them, and each edge comes once (as
    ``graph.undirected`` gives them): then nothing is numbered or joined again.
    """
    if in_order:
        every = cut(nodes.groupBy("id").agg(F.count("*").alias("rows")).select("id", "rows", F.col("id").alias("n")))
        pairs = edges.where("src <> dst").select("src", "dst")
    else:
        every = cut(numbered(nodes.groupBy("id").agg(F.min("ord").alias("ord"), F.count("*").alias("rows")), "n", "ord", "id"))
        at = every.select("id", "n")
        pairs = edges.where("src <> dst").join(at.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
        pairs = cut(pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    ways = _both(pairs)
    total = 2.0 * pairs.count()
    at = every.select("id", "n")
    member = at.select("id", F.col("n").alias("own"))
    while total:
        level = _level(ways, total, resolution)
        settled, moved = _settle(level)
        tables = [ways, level.nodes, level.packed, level.touched, settled, *([level.hubs] if level.hubs is not None else [])]
        if not moved:
            drop(*tables)
            break
        up = settled.select(F.col("id").alias("own"), F.col("own").alias("top"))
        before, member = member, cut(member.join(up, "own", "left").select("id", F.coalesce("top", "own").alias("own")))
        ways = _contracted(level, settled)
        drop(*tables, before)
    drop(pairs)
    first = member.join(at, "id").groupBy("own").agg(F.min("n").alias("first"))
    found = member.join(numbered(first, "community", "first").select("own", "community"), "own").join(every.select("id", "rows"), "id")
    return found.select("id", "community", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_")).drop("_")
