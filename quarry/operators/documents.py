"""The document loop: module map, findings, drafts, critique, synthesis and the quality report.

Modules are rows: each round handles all unfinished ones together, three rounds
at most.  A language model is an optional function of rows; without one every
step is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scores
from quarry.functions.text import markdown_table, module_slug
from quarry.operators import graph
from quarry.sources.scratch import cut

ROUNDS = 3


def module_map(modules: DataFrame) -> DataFrame:
    """modules (module, files, entities, cohesion) as entries; importance is the cohesion, or one half."""
    return modules.select(F.col("module").alias("name"), F.concat(F.lit("Module "), "module", F.lit(" with "), F.size("files").cast("string"), F.lit(" files")).alias("description"), "files", F.col("entities").alias("key_entities"), F.coalesce("cohesion", F.lit(0.5)).alias("importance"))


def whole_repository(nodes: DataFrame) -> DataFrame:
    """One entry for everything: all files, ten functions and five classes."""
    names = lambda kind, k: F.slice(F.array_compact(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "name"))))), 1, k)
    one = nodes.agg(F.array_sort(F.collect_set("file")).alias("files"), names("function", 10).alias("f"), names("class", 5).alias("c"))
    return one.select(F.lit("root").alias("name"), F.lit("Whole repository").alias("description"), "files", F.transform(F.concat("f", "c"), lambda s: s["name"]).alias("key_entities"), F.lit(0.5).alias("importance"))


def module_map_or_whole(modules: DataFrame, nodes: DataFrame) -> DataFrame:
    entries = module_map(modules)
    none = modules.agg((F.count("*") == 0).alias("none"))
    return entries.unionByName(whole_repository(nodes).crossJoin(F.broadcast(none)).where("none").drop("none"))  # one row each


def module_entries(names: DataFrame, entries: DataFrame) -> DataFrame:
    """The entry of each wanted name; one without an entry gets an empty one."""
    none = F.array().cast("array<string>")
    found = names.select("name").join(entries, "name", "left")
    return found.select("name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("files", none).alias("files"), F.coalesce("key_entities", none).alias("key_entities"), F.coalesce("importance", F.lit(0.5)).alias("importance"))


def _joined(rows: DataFrame, text: str, name: str, separator: str = "\n") -> DataFrame:
    """(name, ``name``): the texts of each module in the order of their position."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(text).alias("t")))), lambda x: x["t"])
    return rows.groupBy(F.col("module").alias("name")).agg(F.array_join(lines, separator).alias(name))


def analyst_inputs(entries: DataFrame, entities: DataFrame, signals: DataFrame, subgraphs: DataFrame, crossings: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a module with the text of a prompt: what is known of it, or a note that nothing is.

    entities (module, position, name), signals (module, signals), subgraphs (module,
    position, label), crossings (module, position, line), chunks (module, position, text).
    """
    parts = [
        ("Top entities", _joined(entities, "name", "entities", ", "), "entities", "(no top entities)"),
        ("Code chunks", _joined(chunks, "text", "chunks", "\n\n---\n\n"), "chunks", "(no code chunks matched)"),
        ("Internal calls", _joined(subgraphs, "label", "subgraph"), "subgraph", "(no internal edges)"),
        ("Cross-module edges", _joined(crossings, "line", "crossing"), "crossing", "(no cross-module edges)"),
        ("Signals", signals.select(F.col("module").alias("name"), F.array_join("signals", "\n").alias("signals")), "signals", "(no signals)"),
    ]
    out = entries
    for _, rows, column, _ in parts:
        out = out.join(rows.select("name", F.col(column).alias(f"_{column}")), "name", "left")
    head = [F.concat(F.lit("Module: "), "name"), F.concat(F.lit("Description: "), "description"), F.concat(F.lit("Files:\n"), F.array_join("files", "\n")), F.concat(F.lit("Key entities: "), F.array_join("key_entities", ", "))]
    told = [F.concat(F.lit(f"{title}:\n"), F.coalesce(F.nullif(F.col(f"_{column}"), F.lit("")), F.lit(none))) for title, _, column, none in parts]
    return out.select("name", F.concat_ws("\n\n", *head, *told).alias("prompt"))


def module_lines(modules: DataFrame) -> DataFrame:
    """(module, line): the listing of modules (module, files, entities, cohesion) that a prompt shows."""
    shown = F.concat(F.lit("- "), "module", F.lit(": "), F.size("files").cast("string"), F.lit(" files, cohesion="), F.format_string("%.2f", "cohesion"), F.lit(", top entities: "), F.array_join(F.slice("entities", 1, 5), ", "))
    return modules.select("module", shown.alias("line"))


def entity_lines(top: DataFrame) -> DataFrame:
    """(kind, position, line): the best functions and classes that a prompt shows; top (kind, position, name, file, pagerank)."""
    most, short = F.when(F.col("kind") == "function", 20).when(F.col("kind") == "class", 10), F.when(F.col("kind") == "function", "func").otherwise("class")
    line = F.concat(F.lit("  "), short, F.lit(": "), "name", F.lit(" ("), "file", F.lit(") [pagerank="), F.format_string("%.4f", "pagerank"), F.lit("]"))
    return top.where(F.col("position") <= most).select("kind", "position", line.alias("line"))


def explorer_input(modules: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row with the prompt that asks for a module map: all modules by name, then the best functions and classes, or a note that there are none."""
    top = entity_lines(graph.top_by_kind(ranked))
    in_order = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n")
    known = module_lines(modules).agg(in_order("module").alias("m"))
    best = top.withColumn("n", F.when(F.col("kind") == "function", 0).otherwise(1)).agg(in_order("n", "position").alias("t"))
    said = lambda c, none: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none))
    return known.crossJoin(best).select(F.concat(F.lit("Modules:\n"), said("m", "(no modules)"), F.lit("\n\nTop entities:\n"), said("t", "(no top entities)")).alias("prompt"))  # one row each


def in_module(file: Column, patterns: Column) -> Column:
    """Whether a path begins with a pattern, stars and slashes at its end cut."""
    return F.exists(patterns, lambda p: file.startswith(F.regexp_replace(F.regexp_replace(p, r"\*+$", ""), "/+$", "")))


def module_signals(signals: DataFrame, file_modules: DataFrame, most: int = 50) -> DataFrame:
    """Per module its signals as text lines, the first ``most`` by file and line."""
    from pyspark.sql import Window

    w = Window.partitionBy("module").orderBy("path", "line_number", "category")
    line = F.concat(F.lit("["), "category", F.lit("] "), "path", F.lit(":"), F.col("line_number").cast("string"), F.lit(" "), "line_content")
    picked = signals.join(file_modules.select(F.col("file").alias("path"), "module"), "path").withColumn("p", F.row_number().over(w)).where(F.col("p") <= most)
    return picked.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("p", line.alias("line")))).alias("x")).select("module", F.transform("x", lambda s: s["line"]).alias("signals"))


def findings(entries: DataFrame, entities: DataFrame, signals: DataFrame, deps: DataFrame) -> DataFrame:
    """Per module: five entities as patterns, ten signals, ten dependencies."""
    empty = F.array().cast("array<string>")
    out = deps.groupBy(F.col("source_module").alias("name")).agg(F.array_sort(F.collect_list(F.concat(F.lit("depends on "), "target_module", F.lit(" ("), F.col("edge_count").cast("string"), F.lit(" edges)")))).alias("d"))
    joined = entries.join(entities.select(F.col("module").alias("name"), "entities"), "name", "left").join(signals.select(F.col("module").alias("name"), "signals"), "name", "left").join(out, "name", "left")
    return joined.select(
        "name",
        F.concat(F.col("description"), F.lit(".")).alias("overview"),
        F.slice(F.coalesce("entities", empty), 1, 5).alias("patterns"),
        F.slice(F.coalesce("signals", empty), 1, 10).alias("known_signals"),
        F.slice(F.coalesce("d", empty), 1, 10).alias("dependencies"),
        "files",
    )


def _bullets(values: Column, most: int, none: str) -> Column:
    return F.when(F.size(values) > 0, F.array_join(F.transform(F.slice(values, 1, most), lambda v: F.concat(F.lit("- "), v)), "\n")).otherwise(F.lit(f"- {none}"))


def draft(found: DataFrame) -> DataFrame:
    """The four-section document of each module's findings."""
    code = lambda a: F.transform(a, lambda v: F.concat(F.lit("`"), v, F.lit("`")))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), "name"),
        F.lit(""),
        F.col("overview"),
        F.lit(""),
        F.lit("## Quick Commands"),
        F.lit("- none recorded"),
        F.lit(""),
        F.lit("## Key Files"),
        _bullets(code(F.col("files")), 5, "none"),
        F.lit(""),
        F.lit("## Non-Obvious Patterns"),
        _bullets(code(F.col("patterns")), 3, "none found"),
        _bullets(F.col("known_signals"), 3, "no signals"),
        F.lit(""),
        F.lit("## See Also"),
        _bullets(F.col("dependencies"), 4, "no dependencies"),
    )
    return found.select("name", text.alias("text"))


def critique(drafts: DataFrame, found: DataFrame) -> DataFrame:
    """Four scores and their mean for drafts (name, text), and whether it passes."""
    both = drafts.join(found.select("name", "patterns", "known_signals"), "name")
    text = F.col("text")
    parts = both.select("name", scores.critic_accuracy(text).alias("accuracy"), scores.critic_coverage(text, F.col("patterns"), F.col("known_signals")).alias("coverage"), scores.critic_conciseness(text).alias("conciseness"), scores.critic_usefulness(text).alias("usefulness"))
    overall = F.round((F.col("accuracy") + F.col("coverage") + F.col("conciseness") + F.col("usefulness")) / 4, 3)
    return parts.withColumn("overall", overall).withColumn("passed", overall >= 0.85)


def refine(found: DataFrame, fix: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Final documents and the log of rounds (name, iteration, score, decision).

    ``fix`` may rewrite the drafts of unfinished modules; without it they stay.
    """
    drafts = cut(draft(found))
    log = None
    previous = drafts.select("name", F.lit(0.0).alias("previous"))
    open_ = drafts.select("name")
    for k in range(ROUNDS + 1):
        scored = critique(drafts.join(open_, "name", "left_semi"), found).join(previous, "name", "left")
        row = cut(scored.select("name", F.lit(k).alias("iteration"), F.col("overall").alias("score"), scores.gate(F.col("overall"), F.lit(k), F.col("previous")).alias("decision")))
        log = row if log is None else log.unionByName(row)
        open_ = row.where("decision = 'fix'").select("name")
        if not open_.head(1):
            break
        previous = row.select("name", F.col("score").alias("previous"))
        if fix is not None:
            rewritten = fix(drafts.join(open_, "name", "left_semi"))
            drafts = cut(drafts.join(open_, "name", "left_anti").unionByName(rewritten.select("name", "text")))
    return drafts, log


def last_entries(log: DataFrame) -> DataFrame:
    return log.groupBy("name").agg(F.max_by(F.struct("score", "iteration"), "iteration").alias("x")).select("name", "x.score", "x.iteration")


def quality_report(documents: DataFrame, log: DataFrame) -> DataFrame:
    """Per document its score, rounds and estimated tokens; documents without a log entry score 0."""
    from quarry.operators.chunks import estimated_tokens

    both = documents.join(last_entries(log), "name", "left")
    return both.select(module_slug(F.col("name")).alias("document"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("iteration", F.lit(0)).alias("iterations"), estimated_tokens(F.col("text")).alias("tokens"))


def quality_average(report: DataFrame) -> DataFrame:
    """One row: the mean of scores over zero, 0 without any."""
    return report.agg(F.coalesce(F.avg(F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0)).alias("average"))


def synthesis(entries: DataFrame, found: DataFrame, deps: DataFrame) -> DataFrame:
    """Overview, conventions, agents and dependency index as (name, text)."""
    listed = entries.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "name", "description"))), lambda s: F.concat(F.lit("- **"), s["name"], F.lit("**: "), s["description"])), "\n").alias("t"))
    known = found.select(F.explode("known_signals").alias("t"), "name").agg(F.array_join(F.transform(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("name", "t"))), lambda s: s["t"])), lambda t: F.concat(F.lit("- "), t)), "\n").alias("t"))
    table = deps.agg(markdown_table(F.array_sort(F.collect_list(F.struct(F.col("source_module").alias("source"), F.col("target_module").alias("target"), "edge_count", "direction")))).alias("t"))
    titled = [("OVERVIEW", "# Project Overview", listed), ("CONVENTIONS", "# Conventions", known), ("AGENTS", "# Agents", listed), ("dependency-index", "# Dependency Index", table)]
    out = None
    for name, title, body in titled:
        doc = body.select(F.lit(name).alias("name"), F.concat(F.lit(f"{title}\n\n"), F.coalesce("t", F.lit(""))).alias("text"))
        out = doc if out is None else out.unionByName(doc)
    return out


def benchmark_totals(results: DataFrame) -> DataFrame:
    """One row over results (repo, cost, score, error): total cost, and the mean score of those without an error."""
    return results.agg(F.sum("cost").alias("cost"), F.coalesce(F.avg(F.when(F.col("error").isNull(), F.col("score"))), F.lit(0.0)).alias("score"), F.count("error").alias("failed"))
