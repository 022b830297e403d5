"""The property graph: build, rank, cluster, measure.

Nodes have (id, kind, name, file, ord); edges (src, dst, relation).  ``ord`` is
the order of insertion, which breaks every tie.  Each round is written to
the checkpoint folder, so a lost executor costs at most one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import short_label
from quarry.sources.scratch import bucketed, cut, drop

# Fixed values.
PASSES = ["IMPORTS", "CALLS", "CONTAINS", "INHERITS", "HANDLES"]
TOP = {"function": 50, "file": 30, "class": 20}
CROSSING = ["CALLS", "IMPORTS"]


def node_id(kind: str, *parts: Column) -> Column:
    """The key of a node: file::path, class::path::name, func::path::name, type::, config::, route::path::method."""
    return F.concat_ws("::", F.lit(kind), *parts)


def method_name(owner: Column, name: Column) -> Column:
    return F.concat_ws(".", owner, name)


def last_wins(df: DataFrame, keys: list[str], order: str, first: bool = False) -> DataFrame:
    """One row a key: the one added last (or first).  max_by keeps the map-side combine that a window would lose."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if first else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of one id become one: the last added, but the first for routes."""
    routes = F.col("kind") == "route"
    both = nodes.withColumn("_o", F.when(routes, -F.col("ord")).otherwise(F.col("ord")))
    return last_wins(both, ["id"], "_o").drop("_o")


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge a pair, the relation of the latest pass; IMPORTS and CALLS need both ends among the nodes."""
    ids = nodes.select("id")
    known = edges.where(F.col("relation").isin(CROSSING)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    every = known.unionByName(edges.where(~F.col("relation").isin(CROSSING)))
    rank = F.array_position(F.array(*map(F.lit, PASSES)), F.col("relation"))
    return last_wins(every.select("src", "dst", "relation").withColumn("_p", rank), ["src", "dst"], "_p").select("src", "dst", "relation")


def inherits(nodes: DataFrame, bases: DataFrame) -> DataFrame:
    """INHERITS edges: bases (id, base) to every class of that name but itself."""
    classes = nodes.where("kind = 'class'").select(F.col("id").alias("dst"), F.col("name").alias("base"))
    return bases.select(F.col("id").alias("src"), "base").join(classes, "base").where("src <> dst").select("src", "dst", F.lit("INHERITS").alias("relation"))


def handles(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """HANDLES edges: routes (id, file, handler) to functions of that name in the file, else anywhere."""
    functions = nodes.where("kind = 'function'").select(F.col("id").alias("dst"), F.col("name").alias("handler"), F.col("file").alias("f"))
    here = routes.join(functions, "handler").where("file = f").select(F.col("id").alias("src"), "dst")
    left = routes.join(here.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    there = left.join(functions, "handler").select(F.col("id").alias("src"), "dst")
    return here.unionByName(there).withColumn("relation", F.lit("HANDLES"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def links_of(edges: DataFrame, out: DataFrame) -> DataFrame:
    """(src, part, dst): the edges of a source of several parts are dealt over these, a vertex cut; out is (src, degree, parts)."""
    hubs = F.broadcast(out.where("parts > 1").select("src", "parts"))  # some four for each task
    salt = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")
    return edges.join(hubs, "src", "left").select("src", F.coalesce(salt, F.lit(0)).alias("part"), "dst")


def degrees(edges: DataFrame, most: int) -> DataFrame:
    """(src, degree, parts): out-degrees, and over how many parts of at most some ``most`` edges a source's are dealt."""
    return edges.groupBy("src").agg(F.count("*").alias("degree")).withColumn("parts", F.ceil(F.col("degree") / most))


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(id, pagerank): unweighted, uniform restart, dangling mass spread evenly.

    ``rounds`` fixes the number of rounds; else they end when the total change is
    under ``tolerance`` a node.  Edges and degrees are written once, in buckets of
    (source, part), so no round shuffles or sorts them: a table of the sources' shares is
    built for each bucket, and the share of a source is copied to its parts, of which a
    source with more than a quarter of a task's share of edges has several.  Nodes join their own partial sums, so one shuffle of at most one row a
    target and task brings a round together.  A round's table goes when the next is
    written.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = cut(edges.select("src", "dst"))
    out = cut(degrees(edges, max(1, edges.count() // (4 * tasks))))
    with bucketed(links_of(edges, out), tasks, "src", "part") as links:
        known = nodes.select("id").join(out.withColumnRenamed("src", "id"), "id", "left")
        rank = cut(known.select("id", "degree", F.coalesce("parts", F.lit(0)).cast("int").alias("parts"), F.lit(1.0 / n).alias("pagerank")))
        at_sinks = F.coalesce(F.sum(F.when(F.col("parts") == 0, F.col("pagerank"))), F.lit(0.0))
        lost = rank.agg(at_sinks).head()[0]
        for _ in range(rounds if rounds is not None else most):
            share = (F.col("pagerank") / F.col("degree")).alias("got")
            copies = rank.where("parts > 0").select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), share)
            none = F.lit(None)
            got = links.join(copies.hint("shuffle_hash"), ["src", "part"]).select(F.col("dst").alias("id"), "got", none.cast("long").alias("degree"), none.cast("int").alias("parts"), none.cast("double").alias("before"))
            own = rank.select("id", F.lit(0.0).alias("got"), "degree", "parts", F.col("pagerank").alias("before"))
            sums = got.unionByName(own).groupBy("id").agg(F.sum("got").alias("got"), *(F.max(c).alias(c) for c in ("degree", "parts", "before"))).where("before is not null")
            value = F.lit((1 - damping) / n + damping * lost / n) + damping * F.col("got")
            last, rank = rank, cut(sums.select("id", "degree", "parts", value.alias("pagerank"), "before"))
            drop(last)
            lost, change = rank.agg(at_sinks, F.sum(F.abs(F.col("pagerank") - F.col("before")))).head()
            if rounds is None and change < n * tolerance:
                break
    drop(edges, out)
    return rank.select("id", "pagerank")


def top_by_kind(ranked: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The best nodes of each kind; ties keep the order of insertion."""
    w = Window.partitionBy("kind").orderBy(F.desc("pagerank"), "ord")
    limit = F.create_map(*(F.lit(x) for kv in (limits or TOP).items() for x in kv))[F.col("kind")]
    return ranked.where(limit.isNotNull()).withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def top_in_group(ranked: DataFrame, group: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc("pagerank"), "ord")
    return ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways() -> Column:
    """The two sides (id, near) of an edge, one of a loop."""
    side = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("near"))
    return F.when(F.col("src") == F.col("dst"), F.array(side("src", "dst"))).otherwise(F.array(side("src", "dst"), side("dst", "src")))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: modularity of a partition (id, community) of an undirected graph; 0 without edges.

    An id with several rows counts each of its edges for each of them; such rows are counted first, not joined.
    """
    at = membership.groupBy("id", "community").agg(F.count("*").alias("n"))
    both = edges.join(at.select(F.col("id").alias("src"), F.col("community").alias("a"), F.col("n").alias("na")), "src").join(at.select(F.col("id").alias("dst"), F.col("community").alias("b"), F.col("n").alias("nb")), "dst")
    pairs = both.groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("ends"))
    within = F.when(F.col("a") == F.col("b"), F.col("ends")).otherwise(0)
    end = lambda c, w: F.struct(F.col(c).alias("community"), w.alias("within"), "ends")
    sums = pairs.select(F.explode(F.array(end("a", within), end("b", F.lit(0).cast("long")))).alias("e")).select("e.*").groupBy("community").agg(F.sum("within").alias("l"), F.sum("ends").alias("d"))
    total = sums.agg((F.sum("d") / 2).alias("m"), F.sum("l").alias("inner"), F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return total.select(F.coalesce(F.col("inner") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m")), F.lit(0.0)).alias("modularity"))


def cohesion(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Per community: internal and external edges of its members in the whole undirected graph, and the internal share.

    Every neighbour of a member counts once from that member's side; internal ones are seen twice and halved downwards.
    """
    at = membership.select("id", "community")
    sides = undirected(edges)
    ways = sides.select(F.explode(both_ways()).alias("e")).select("e.*")
    seen = ways.join(at, "id").join(at.select(F.col("id").alias("near"), F.col("community").alias("other")), "near", "left")
    same = F.coalesce(F.col("community") == F.col("other"), F.lit(False)).cast("long")
    sums = seen.groupBy("community").agg(F.floor(F.sum(same) / 2).alias("internal_edges"), F.sum(1 - same).alias("external_edges"))
    every = at.select("community").distinct().join(sums, "community", "left").na.fill(0, ["internal_edges", "external_edges"])
    total = F.col("internal_edges") + F.col("external_edges")
    return every.withColumn("cohesion", F.when(total == 0, 0.0).otherwise(F.col("internal_edges") / F.nullif(total, F.lit(0))))


def dominant_directory(files: DataFrame) -> DataFrame:
    """Per community the most common first part of its files' paths; ties go to the one seen first in path order."""
    head = F.split_part("path", F.lit("/"), F.lit(1))
    per = files.groupBy("community", head.alias("dir")).agg(F.count("*").alias("n"), F.min("path").alias("first"))
    most = per.groupBy("community").agg(F.max("n").alias("n"))
    return per.join(most, ["community", "n"]).groupBy("community").agg(F.min_by("dir", "first").alias("dir"))


def module_names(named: DataFrame) -> DataFrame:
    """Unique names: a directory that an earlier community has gets the community's number."""
    w = Window.partitionBy("dir").orderBy("community")
    again = F.row_number().over(w) > 1
    return named.select("community", F.when(again, F.concat_ws("-", "dir", F.col("community").cast("string"))).otherwise(F.col("dir")).alias("module"))


def with_module(nodes: DataFrame, file_modules: DataFrame) -> DataFrame:
    return nodes.join(file_modules.select("file", "module"), "file", "left").select(*nodes.columns, "module")


def crossing_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """CALLS and IMPORTS edges whose ends lie in two different, known modules; ``modules`` has (id, module)."""
    m = modules.where("module is not null and module <> ''").select("id", "module")
    a, b = m.select(F.col("id").alias("src"), F.col("module").alias("source_module")), m.select(F.col("id").alias("dst"), F.col("module").alias("target_module"))
    return edges.where(F.col("relation").isin(CROSSING)).join(a, "src").join(b, "dst").where("source_module <> target_module")


def module_dependencies(crossing: DataFrame, ranked: DataFrame, keep: int = 3) -> DataFrame:
    """Per module pair: edges, the ``keep`` best ranked targets, and whether the other way exists."""
    keys = ["source_module", "target_module"]
    per = cut(crossing.groupBy(*keys, "dst").agg(F.count("*").alias("n")))  # the edges are read once
    targets = per.select(*keys, "dst").join(ranked.select(F.col("id").alias("dst"), "pagerank", "ord"), "dst")
    w = Window.partitionBy(*keys).orderBy(F.desc("pagerank"), "ord")
    best = targets.withColumn("p", F.row_number().over(w)).where(F.col("p") <= keep).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", short_label(F.col("dst")).alias("label")))).alias("top"))
    counts = per.groupBy(*keys).agg(F.sum("n").alias("edge_count"))
    back = counts.select(F.col("target_module").alias("source_module"), F.col("source_module").alias("target_module"), F.lit(True).alias("mutual"))
    return counts.join(best, keys).join(back, keys, "left").select(*keys, "edge_count", F.transform("top", lambda t: t["label"]).alias("key_connections"), F.when(F.col("mutual"), "mutual").otherwise("uses").alias("direction"))


def callers(edges: DataFrame, ranked: DataFrame, keep: int = 3) -> DataFrame:
    """The best ranked callers of each node, as labels."""
    called = edges.where("relation = 'CALLS'").join(ranked.select(F.col("id").alias("src"), "pagerank", "ord"), "src")
    w = Window.partitionBy("dst").orderBy(F.desc("pagerank"), "ord")
    top = called.withColumn("p", F.row_number().over(w)).where(F.col("p") <= keep)
    return top.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list(F.struct("p", short_label(F.col("src")).alias("l")))).alias("x")).select("id", F.transform("x", lambda s: s["l"]).alias("callers"))


def callees(edges: DataFrame, nodes: DataFrame, keep: int = 10) -> DataFrame:
    """The first callees of each node by order of insertion."""
    called = edges.where("relation = 'CALLS'").join(nodes.select(F.col("id").alias("dst"), "ord"), "dst")
    w = Window.partitionBy("src").orderBy("ord")
    top = called.withColumn("p", F.row_number().over(w)).where(F.col("p") <= keep)
    return top.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("p", short_label(F.col("dst")).alias("l")))).alias("x")).select("id", F.transform("x", lambda s: s["l"]).alias("callees"))


def rank_position(score: Column, top_scores: Column) -> Column:
    """1 and the number of known top scores that are strictly greater."""
    return F.size(F.filter(top_scores, lambda s: s > score)) + 1


def impact(deps: DataFrame) -> DataFrame:
    """Per module what it depends on and what depends on it, as sorted lists."""
    out = deps.groupBy(F.col("source_module").alias("module")).agg(F.array_sort(F.collect_set("target_module")).alias("depends_on"))
    back = deps.groupBy(F.col("target_module").alias("module")).agg(F.array_sort(F.collect_set("source_module")).alias("used_by"))
    none = F.array().cast("array<string>")
    return out.join(back, "module", "full").select("module", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("used_by", none).alias("used_by"))


def module_subgraphs(edges: DataFrame, modules: DataFrame, most: int = 60) -> DataFrame:
    """(module, position, label): per module its distinct labelled CALLS and IMPORTS edges with an end inside, the first ``most`` by label."""
    m = modules.where("module is not null").select("id", "module")
    label = F.concat(short_label(F.col("src")), F.lit(" -"), F.col("relation"), F.lit("-> "), short_label(F.col("dst")))
    # both ends of an edge as rows, so that the edges are read once; ranks of equal labels are equal, so tasks keep few before modules meet
    ends = edges.where(F.col("relation").isin(CROSSING)).select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), label.alias("label"))
    w = Window.partitionBy("module").orderBy("label")
    return ends.join(m, "id").select("module", "label", F.dense_rank().over(w).alias("position")).where(F.col("position") <= most).distinct()


def module_subgraph(edges: DataFrame, modules: DataFrame, module: str, most: int = 60) -> DataFrame:
    """Labels of one module, in order."""
    return module_subgraphs(edges, modules.where(F.col("module") == module), most).select("label")


def module_crossings(edges: DataFrame, modules: DataFrame, most: int = 40) -> DataFrame:
    """(module, position, line): per module its crossing edges, those that leave and those that come, the first ``most`` by their line."""
    ends = crossing_edges(edges, modules).select("src", "dst", "relation", "source_module", "target_module")
    named = modules.select("id", "name")
    both = ends.join(named.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    tail = F.concat(F.lit(" ["), "relation", F.lit("]"))
    leaving = both.select(F.col("source_module").alias("module"), F.concat("a", F.lit(" → "), "b", F.lit(" (in "), "target_module", F.lit(")"), tail).alias("line"))
    coming = both.select(F.col("target_module").alias("module"), F.concat("a", F.lit(" (in "), "source_module", F.lit(") → "), "b", tail).alias("line"))
    w = Window.partitionBy("module").orderBy("line")
    return leaving.unionByName(coming).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
