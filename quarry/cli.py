"""Command line: parse, generate, evaluate, refresh, run, benchmark."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import SparkSession

from quarry import pipeline
from quarry.operators import documents
from quarry.sources import repo
from quarry.sources.folders import PUSHDOWN


def named(function: str | None) -> Callable | None:
    """The callable that "module:name" names; None without one."""
    if not function:
        return None
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "generate", "evaluate", "refresh", "run"):
        c = commands.add_parser(name)
        if name != "evaluate" and name != "generate":
            c.add_argument("source", help="a folder or the address of a repository")
        c.add_argument("--output", default="quarry-output")
        if name in ("parse", "run"):
            c.add_argument("--branch")
            c.add_argument("--languages", default="")
        if name == "run":
            c.add_argument("--skip-evaluate", action="store_true")
        for hook in {"parse": ["embed", "count"], "refresh": ["embed", "count"], "generate": ["fix", "embed"], "evaluate": ["judge"]}.get(name, []):
            c.add_argument(f"--{hook}", help="a callable, as module:name")
        if name == "evaluate":
            c.add_argument("--repo", help="a folder whose files the references are held to")
    c = commands.add_parser("benchmark", help="parse, generate and evaluate several repositories, one after the other")
    c.add_argument("sources", nargs="+", help="folders or addresses of repositories")
    c.add_argument("--output", default="quarry-output")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").config("spark.checkpoint.dir", f"{a.output}/.checkpoints").config(PUSHDOWN, "true").getOrCreate()
    source = getattr(a, "source", None)
    if source and ("://" in source or source.startswith("git@")):
        source = repo.checkout(source, f"{a.output}/.source", getattr(a, "branch", None))
    languages = [x.strip().lower() for x in getattr(a, "languages", "").split(",") if x.strip()] or None
    if a.command == "parse":
        parsed = pipeline.parse(spark, source, a.output, languages=languages, embed=named(a.embed), count=named(a.count))
        parsed.files.groupBy("file_type", "language").count().show()
    elif a.command == "generate":
        pipeline.generate(spark, a.output, named(a.fix), named(a.embed)).show(truncate=False)
    elif a.command == "evaluate":
        scored, gaps = pipeline.assess(spark, a.output, root=a.repo, judge=named(a.judge))
        scored.select("name", "composite_score").show(truncate=False)
        gaps.show(truncate=False)
    elif a.command == "benchmark":
        roots = [repo.checkout(x, f"{a.output}/.source{k}") if "://" in x or x.startswith("git@") else x for k, x in enumerate(a.sources)]
        results = pipeline.run_benchmark(spark, roots, a.output)
        results.show(truncate=False)
        documents.benchmark_totals(results).show()
    elif a.command == "refresh":
        pipeline.update(spark, source, a.output, embed=named(a.embed), count=named(a.count)).show(truncate=False)
    else:
        pipeline.run(spark, source, a.output, languages=languages, skip_evaluate=a.skip_evaluate)


if __name__ == "__main__":
    main()
