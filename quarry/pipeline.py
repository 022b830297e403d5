"""The commands end to end: parse, generate, evaluate, refresh, run and the benchmark loop."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import classify, text
from quarry.operators import chunks, documents, evaluate, extract, graph, refresh, resolve
from quarry.operators.communities import communities
from quarry.sources import repo, snapshots
from quarry.sources.scratch import cut, numbered


@dataclass
class Parsed:
    files: DataFrame
    extractions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    modules: DataFrame
    deps: DataFrame


def nodes_of(files: DataFrame, ext: DataFrame) -> DataFrame:
    """Nodes of all kinds with their order of insertion; a route's key names no file, so the first one stands."""
    base = files.select(graph.node_id("file", F.col("path")).alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file"), F.lit(0).alias("p"), F.lit(0).alias("pos"))

    def part(column: str, prefix: str, kind: str, number: int, name: str = "x.name") -> DataFrame:
        rows = ext.select("path", F.posexplode(column).alias("pos", "x"))
        return rows.select(graph.node_id(prefix, F.col("path"), F.col(name)).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col("path").alias("file"), F.lit(number).alias("p"), "pos")

    methods = ext.select("path", F.explode("classes").alias("c")).select("path", "c.name", F.posexplode("c.methods").alias("pos", "m"))
    full = graph.method_name(F.col("name"), F.col("m.name"))
    methods = methods.select(graph.node_id("func", F.col("path"), full).alias("id"), F.lit("function").alias("kind"), F.col("m.name").alias("name"), F.col("path").alias("file"), F.lit(3).alias("p"), "pos")
    routes = ext.select("path", F.posexplode("route_handlers").alias("pos", "x")).select(graph.node_id("route", F.col("x.path"), F.col("x.method")).alias("id"), F.lit("route").alias("kind"), F.col("x.path").alias("name"), F.col("path").alias("file"), F.lit(6).alias("p"), "pos")
    out = base
    for df in (part("functions", "func", "function", 1), part("classes", "class", "class", 2), methods, part("type_defs", "type", "type", 4), part("constants", "config", "config", 5), routes):
        out = out.unionByName(df)
    return graph.merge_nodes(numbered(out, "ord", "file", "p", "pos", "id").select("id", "kind", "name", "file", "ord"))


def resolved_calls(used: DataFrame, functions: DataFrame, methods: DataFrame) -> DataFrame:
    """Inferred uses (file, name, used, target) with ``resolved``: the path and name of the function that is meant, if one is."""
    calls = used.distinct().withColumn("call", F.struct("file", "name", "used", "target"))
    calls = calls.select("call", F.concat_ws("::", "target", "used").alias("callee"), F.col("target").alias("target_file"))
    symbols = functions.select(F.concat_ws("::", "file", "name").alias("qname"), F.col("name").alias("short_name"), "file")
    symbols = symbols.unionByName(methods.select(F.concat_ws("::", "file", graph.method_name(F.col("cls"), F.col("name"))).alias("qname"), F.col("name").alias("short_name"), "file"))
    return resolve.resolve_callees(calls, symbols).select("call.*", "resolved")


def edges_of(ext: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    imports = resolved.where(F.col("resolution").isin("exact", "fuzzy")).select(graph.node_id("file", F.col("file")).alias("src"), graph.node_id("file", F.col("target")).alias("dst"), F.lit("IMPORTS").alias("relation"))
    methods = ext.select(F.col("path").alias("file"), F.explode("classes").alias("c")).select("file", F.col("c.name").alias("cls"), F.explode("c.methods").alias("m")).select("file", "cls", F.col("m.name").alias("name"))
    inner = resolve.method_calls(methods).select(graph.node_id("func", F.col("file"), graph.method_name(F.col("cls"), F.col("caller"))).alias("src"), graph.node_id("func", F.col("file"), graph.method_name(F.col("cls"), F.col("callee"))).alias("dst"), F.lit("CALLS").alias("relation"))
    functions = ext.select(F.col("path").alias("file"), F.explode("functions").alias("f")).select("file", "f.*")
    names = resolve.import_names(resolved)
    used = resolve.decorator_calls(functions, names).unionByName(resolve.type_mentions(functions, names, "return_type").drop("value")).unionByName(resolve.type_mentions(functions, names, "parameters").drop("value"))
    called = resolved_calls(used, functions, methods).where("resolved is not null").select(graph.node_id("func", F.col("file"), F.col("name")).alias("src"), F.concat(F.lit("func::"), "resolved").alias("dst"), F.lit("CALLS").alias("relation"))
    heirs = ext.select(F.col("path").alias("file"), F.explode("classes").alias("c")).select("file", F.col("c.name").alias("cls"), F.explode("c.bases").alias("base"))
    above = resolve.super_calls(methods, heirs, names).select(graph.node_id("func", F.col("file"), graph.method_name(F.col("cls"), F.col("name"))).alias("src"), graph.node_id("func", F.col("target"), graph.method_name(F.col("base"), F.col("name"))).alias("dst"), F.lit("CALLS").alias("relation"))
    local = resolve.local_return_calls(functions).select(graph.node_id("func", F.col("file"), F.col("name")).alias("src"), graph.node_id("func", F.col("file"), F.col("callee")).alias("dst"), F.lit("CALLS").alias("relation"))
    contains = nodes.where("kind in ('class', 'type', 'config')").select(graph.node_id("file", F.col("file")).alias("src"), F.col("id").alias("dst"))
    contains = contains.unionByName(ext.select("path", F.explode("functions").alias("f")).select(graph.node_id("file", F.col("path")).alias("src"), graph.node_id("func", F.col("path"), F.col("f.name")).alias("dst")))
    contains = contains.unionByName(methods.select(graph.node_id("class", F.col("file"), F.col("cls")).alias("src"), graph.node_id("func", F.col("file"), graph.method_name(F.col("cls"), F.col("name"))).alias("dst"))).withColumn("relation", F.lit("CONTAINS"))
    bases = ext.select("path", F.explode("classes").alias("c")).select(graph.node_id("class", F.col("path"), F.col("c.name")).alias("id"), F.explode("c.bases").alias("base"))
    routes = ext.select("path", F.explode("route_handlers").alias("r")).select(graph.node_id("route", F.col("r.path"), F.col("r.method")).alias("id"), F.col("path").alias("file"), F.col("r.handler_function").alias("handler"))
    every = imports.unionByName(inner).unionByName(called).unionByName(above).unionByName(local).unionByName(contains).unionByName(graph.inherits(nodes, bases)).unionByName(graph.handles(routes, nodes))
    return graph.merge_edges(every, nodes)


def settings_of(found: DataFrame) -> tuple[list[str], dict[str, str], str]:
    """Source folders, path aliases and the Go module path of a repository: a few values from its own configuration files."""
    bases = ["src", ""] if found.where("path like 'src/%'").head(1) else [""]
    config = found.where("path in ('tsconfig.json', 'jsconfig.json')").orderBy(F.desc("path")).limit(1)
    aliases = {r["alias"] + "/": f"{r['target'].removeprefix('./')}/" for r in repo.path_aliases(config).collect()}
    return bases, aliases, repo.go_module(found.where("path = 'go.mod'")).head()["module_path"]


def resolved_imports(found: DataFrame, ext: DataFrame) -> DataFrame:
    source = found.where(classify.is_parsed(F.col("path")))
    bases, aliases, go_module = settings_of(found)
    listed = ext.select("path", F.posexplode("imports").alias("pos", "i")).join(source.select("path", "language"), "path")
    imports = numbered(listed, "imp", "path", "pos").select("imp", F.col("path").alias("file"), "language", "i.module", "i.names")
    return resolve.resolve_imports(imports, source, bases=bases, aliases=aliases, go_module=go_module)


def build(found: DataFrame, ext: DataFrame, output: str | None = None, *, embed=None, count=None) -> Parsed:
    """Files and their extractions to ranked graph, modules and chunks, written to ``output`` where given."""
    source = found.where(classify.is_parsed(F.col("path")))
    resolved = cut(resolved_imports(found, ext))
    nodes = cut(nodes_of(source, ext))
    edges = cut(edges_of(ext, resolved, nodes))
    ranked = cut(nodes.join(graph.pagerank(nodes, edges), "id"))
    files = nodes.where("kind = 'file'")
    member = communities(files, graph.induced(edges, files)).join(files.select("id", "file"), "id")
    named = graph.module_names(graph.dominant_directory(member.select("community", F.col("file").alias("path"))))
    file_modules = cut(member.join(named, "community").select("file", "module", "community", "id"))
    ranked = cut(graph.with_module(ranked, file_modules))
    tops = graph.top_in_group(edges.where("relation = 'CONTAINS'").join(files.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(ranked, "id"), "module", 5)
    entities = tops.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("e")).select("module", F.transform("e", lambda s: s["name"]).alias("entities"))
    size = graph.cohesion(edges, file_modules.select("id", "community")).join(named, "community")
    lists = file_modules.groupBy("module").agg(F.array_sort(F.collect_list("file")).alias("files"))
    modules = lists.join(size.select("module", "internal_edges", "external_edges", "cohesion"), "module").join(entities, "module", "left").select("module", "files", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), "internal_edges", "external_edges", "cohesion")
    deps = graph.module_dependencies(graph.crossing_edges(edges, ranked), ranked)
    out = Parsed(found, ext, ranked, edges, cut(modules), cut(deps))
    if output:
        for name in ("nodes", "edges", "modules", "deps"):
            repo.save(getattr(out, name), f"{output}/{name}")
        for name, rows in (("files", found), ("extractions", ext), ("manifest", found.select("path", F.col("content_hash").alias("hash")))):
            snapshots.replace(rows, f"{output}/{name}", "path")  # what did not change is not written
        repo.save(file_modules.select(F.col("file").alias("path"), "module"), f"{output}/assignments")
        functions = ext.select(F.col("path").alias("file"), F.explode("functions").alias("f")).select("file", "f.*")
        methods = ext.select(F.col("path").alias("file"), F.explode("classes").alias("c")).select("file", F.col("c.name").alias("cls"), F.explode("c.methods").alias("m")).select("file", "cls", F.col("m.name").alias("name"))
        names = resolve.import_names(resolved)
        used = resolve.decorator_calls(functions, names).unionByName(resolve.type_mentions(functions, names, "return_type").drop("value")).unionByName(resolve.type_mentions(functions, names, "parameters").drop("value"))
        repo.save(resolve.resolution_rate(resolved_calls(used, functions, methods)), f"{output}/resolution_rate")
        repo.save(repo.node_link(ranked, edges), f"{output}/graph.jsonl", form="text")
        fresh = chunks.embedded(chunks.of_repository(found, ext, ranked, edges, count=count), embed)
        repo.store_vectors(fresh, f"{output}/chunks")
    return out


def parse(spark: SparkSession, root: str, output: str | None = None, *, languages: list[str] | None = None, embed=None, count=None) -> Parsed:
    """Files to ranked graph, modules and chunks.  ``embed`` and ``count`` are an embedder and a batch tokenizer, where there are any."""
    found = cut(repo.files(spark, root, languages=languages, ignore=repo.ignore_lines(spark, root)))
    if output:
        repo.save(spark.createDataFrame([(languages, repo.head_commit(root), datetime.now(UTC).isoformat())], "languages array<string>, commit string, parsed_at string"), f"{output}/settings")
    return build(found, cut(extract.extractions(found.where(classify.is_parsed(F.col("path"))))), output, embed=embed, count=count)


def stored(spark: SparkSession, output: str) -> Parsed:
    """What ``parse`` wrote; an error names what is missing."""
    found = {n: repo.load(spark, f"{output}/{n}") for n in ("files", "extractions", "nodes", "edges", "modules", "deps")}
    if missing := [n for n, df in found.items() if df is None]:
        raise FileNotFoundError(f"run parse first: {', '.join(missing)} missing in {output}")
    return Parsed(**found)


def prompts(spark: SparkSession, output: str, embed=None) -> DataFrame:
    """(name, prompt): what an analyst would be told of each module, with the nearest chunks where an embedder is given."""
    p = stored(spark, output)
    entries = documents.module_entries(p.modules.select(F.col("module").alias("name")), documents.module_map(p.modules)) if p.modules.head(1) else documents.whole_repository(p.nodes)
    file_modules = p.modules.select("module", F.explode("files").alias("file"))
    signals = p.extractions.select("path", F.explode("signal_lines").alias("s")).select("path", "s.*")
    none = spark.createDataFrame([], "module string, position int, text string")
    vectors = repo.load(spark, f"{output}/chunks")
    if embed is not None and vectors is not None:
        asked = chunks.embedded(entries.select(F.col("name").alias("module"), "description"), embed, "description").select(F.col("module").alias("query_id"), "module", F.col("embedding").alias("query"))
        found = chunks.nearest(vectors.where("embedding is not null"), asked, on="module", key="chunk_id")
        none = found.select("module", "position", F.trim("text").alias("text"))
    tops = graph.top_in_group(p.nodes.where("module is not null"), "module", chunks.TOP).select("module", "position", "name")
    return documents.analyst_inputs(entries, tops, documents.module_signals(signals, file_modules), graph.module_subgraphs(p.edges, p.nodes), graph.module_crossings(p.edges, p.nodes), none)


def generate(spark: SparkSession, output: str, fix=None, embed=None) -> DataFrame:
    """Documents, prompts, log and quality report of a parsed repository."""
    p = stored(spark, output)
    repo.save(prompts(spark, output, embed), f"{output}/prompts")
    entries = documents.module_map_or_whole(p.modules, p.nodes)
    repo.save(documents.explorer_input(p.modules, p.nodes), f"{output}/explorer_prompt")
    file_modules = p.modules.select("module", F.explode("files").alias("file"))
    signals = p.extractions.select("path", F.explode("signal_lines").alias("s")).select("path", "s.*")
    tops = p.modules.select("module", "entities")
    found = cut(documents.findings(entries, tops, documents.module_signals(signals, file_modules), p.deps))
    docs, log = documents.refine(found, fix)
    every = cut(docs.withColumn("file", text.module_slug(F.col("name"))).unionByName(documents.synthesis(entries, found, p.deps).withColumn("file", F.col("name"))))
    repo.write_documents(every.select(F.col("file").alias("name"), "text"), f"{output}/context", slug=False)
    every = every.drop("file")
    report = documents.quality_report(every, log)
    repo.save(report, f"{output}/quality_report")
    return report


def assess(spark: SparkSession, output: str, *, root: str | None = None, judge=None) -> tuple[DataFrame, DataFrame]:
    """Evaluations and gaps of the generated documents; references are held to the files of ``root`` where given, usefulness to ``judge``."""
    p = stored(spark, output)
    paths = repo.files(spark, root, every=True).select("path") if root else p.files.select("path")
    docs = repo.documents(spark, f"{output}/context")
    known = evaluate.document_module(docs, p.modules.select("module"))
    own = evaluate.judged_entities(known, p.modules, p.nodes).select("name", "text", "entities")
    scored = evaluate.evaluate(own, paths, p.nodes.select(F.col("name").alias("entity")), judge)
    signals = p.extractions.select("path", F.size(F.coalesce("signal_lines", F.array().cast("array<struct<line_number:int,grp:int,category:string,line_content:string>>"))).alias("signals"))
    configs = p.files.where("file_type = 'config'").select("path").join(signals, "path")
    top = p.nodes.where(F.col("kind").isin("function", "class")).orderBy(F.desc("pagerank"), "ord").limit(20)
    ranks = evaluate.best_rank_by_file(p.nodes.where(F.col("kind").isin("function", "class"))).withColumnRenamed("file", "path")
    found = evaluate.gaps(ranks, top.select("name", "pagerank"), configs, docs)
    owner = evaluate.suggest_module(found.where("gap_type <> 'missing_entity'").select(F.col("subject").alias("path")).distinct(), p.modules.select("module", F.explode("files").alias("path")))
    found = cut(found.join(owner.withColumnRenamed("path", "subject"), "subject", "left").select("gap_type", "subject", "severity", F.coalesce("module", F.lit("")).alias("module")))
    repo.save(scored, f"{output}/evaluation")
    repo.save(evaluate.report(scored), f"{output}/evaluation_report")
    repo.save(found, f"{output}/gaps")
    return scored, found


def update(spark: SparkSession, root: str, output: str, *, embed=None, count=None) -> DataFrame:
    """Detect changes since the last parse, read what changed, rebuild the graph, repair references; the decision row.

    Files are found by the rules of the last parse: its languages and the ignore
    file.  Modules with too many stale files are listed in ``stale_modules``.
    """
    manifest, settings = repo.load(spark, f"{output}/manifest"), repo.load(spark, f"{output}/settings")
    if manifest is None or settings is None:
        raise FileNotFoundError(f"run parse first: no manifest in {output}")
    last = settings.head()
    now = cut(repo.files(spark, root, languages=last["languages"], ignore=repo.ignore_lines(spark, root)))
    changes = cut(refresh.diff(now.select("path", F.col("content_hash").alias("hash")), manifest))
    docs = cut(repo.documents(spark, f"{output}/context", recursive=True))
    broken = cut(refresh.broken_references(docs, now.select("path")))
    distance = repo.commit_distance(root, last["commit"]) if last["commit"] else None
    row = cut(refresh.decision(changes, broken).withColumn("commits", F.lit(distance).cast("int")))
    what = row.head()["decision"]
    repo.save(refresh.module_staleness(changes, repo.load(spark, f"{output}/assignments")).where("is_stale"), f"{output}/stale_modules")
    if what in ("full", "partial"):
        source = now.where(classify.is_parsed(F.col("path")))
        changed = changes.where(F.col("state").isin("stale", "new")).select("path")
        fresh = extract.extractions(source if what == "full" else source.join(changed, "path", "left_semi"))
        old = repo.load(spark, f"{output}/extractions")
        merged = cut(fresh if what == "full" else refresh.merge_extractions(old, fresh, changes))
        build(now, merged, output, embed=embed, count=count)
        repo.save(spark.createDataFrame([(last["languages"], repo.head_commit(root), datetime.now(UTC).isoformat())], settings.schema), f"{output}/settings")
    if broken.head(1):
        fixed = refresh.repaired_documents(docs, broken, refresh.repairs(broken, now.select("path")))
        changed_docs = cut(fixed.join(broken.select("name").distinct(), "name", "left_semi"))
        repo.write_documents(changed_docs.withColumn("name", text.module_of_document(F.col("name"))), f"{output}/context", slug=False)
    return row


def run(spark: SparkSession, root: str, output: str, *, languages: list[str] | None = None, skip_evaluate: bool = False) -> None:
    parse(spark, root, output, languages=languages)
    generate(spark, output)
    if not skip_evaluate:
        assess(spark, output)


def run_benchmark(spark: SparkSession, roots: list[str], output: str) -> DataFrame:
    """One row per repository: seconds, files, lines, mean score and the error that ended it, if any."""
    rows = []
    for k, root in enumerate(roots):
        began, error, score, n, lines = time.time(), None, None, None, None
        try:
            p = parse(spark, root, f"{output}/{k}")
            n, lines = p.files.count(), p.files.agg(F.sum("line_count")).head()[0]
            generate(spark, f"{output}/{k}")
            scored, _ = assess(spark, f"{output}/{k}")
            score = scored.agg(F.avg("composite_score")).head()[0]
        except Exception as e:  # one repository must not end the loop
            error = f"{type(e).__name__}: {e}"[:300]
        rows.append((root, n, lines, float(score) if score is not None else None, 0.0, time.time() - began, error))
    results = spark.createDataFrame(rows, "repo string, files long, lines long, score double, cost double, seconds double, error string")
    repo.save(results, f"{output}/benchmark", form="json")
    return results
