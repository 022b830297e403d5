"""Evaluation of documents, coverage gaps and the report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scores
from quarry.functions import text as text_functions
from quarry.functions.text import basename, module_of_document, normal_name
from quarry.sources.scratch import cut

SYNTHESIS = ["OVERVIEW.md", "CONVENTIONS.md", "AGENTS.md"]  # fixed values


def is_synthesis(name: Column) -> Column:
    return name.isin(SYNTHESIS)


def judged_entities(docs: DataFrame, modules: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """docs (name, text, module) with the ``entities`` that each should mention.

    A synthesis document is held to the globally best nodes; a document of a module to
    the ``k`` best nodes of it, or to those that the module lists; any other to none.
    """
    best = best_entities(ranked).withColumnRenamed("names", "_best")
    w = Window.partitionBy("module").orderBy(F.desc("pagerank"), "ord")
    top = ranked.where("module is not null").withColumn("p", F.row_number().over(w)).where(F.col("p") <= k)
    own = top.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("p", "name"))).alias("x")).select("module", F.transform("x", lambda s: s["name"]).alias("_own"))
    both = docs.join(own, "module", "left").join(modules.select("module", F.col("entities").alias("_listed")), "module", "left").crossJoin(F.broadcast(best))  # one row
    none = F.array().cast("array<string>")
    return both.select(*docs.columns, F.when(is_synthesis(F.col("name")), F.col("_best")).otherwise(F.coalesce("_own", "_listed", none)).alias("entities"))


def best_entities(ranked: DataFrame, k: int = 20, kinds: list[str] | None = None) -> DataFrame:
    """One row: names of the globally best ranked nodes, in order."""
    rows = ranked.where(F.col("kind").isin(kinds)) if kinds else ranked
    top = rows.orderBy(F.desc("pagerank"), "ord").limit(k)
    return top.agg(F.array_sort(F.collect_list(F.struct((-F.col("pagerank")).alias("p"), "ord", "name"))).alias("x")).select(F.transform("x", lambda s: s["name"]).alias("names"))


def document_module(docs: DataFrame, modules: DataFrame) -> DataFrame:
    """docs (name, …) with ``module``: the exact name, else the normalised one."""
    stem = module_of_document(F.col("name"))
    exact = modules.select(F.col("module").alias("_s"), F.col("module").alias("_exact"))
    loose = modules.groupBy(normal_name(F.col("module")).alias("_n")).agg(F.min("module").alias("_loose"))
    both = docs.withColumn("_s", stem).join(exact, "_s", "left").withColumn("_n", normal_name(stem)).join(loose, "_n", "left")
    return both.select(*docs.columns, F.coalesce("_exact", "_loose").alias("module"))


def evaluate(docs: DataFrame, paths: DataFrame, names: DataFrame, judge: Callable[[str], float | None] | None = None) -> DataFrame:
    """Five scores and the composite of docs (name, text, entities); paths is (path).

    ``names`` has the valid names (entity), of all documents or, with a column
    ``name``, of that document.  Paths and names are joined as rows against
    references, never gathered: a document has few references, a repository any
    number of files and entities.
    """
    refs = docs.select("name", F.explode_outer(F.transform(scores.backtick_references(F.col("text")), lambda r: F.struct(r.alias("ref"), scores.looks_like_path(r).alias("is_path")))).alias("r"))
    flat = refs.select("name", "r.ref", "r.is_path", scores.normal_path(F.col("r.ref")).alias("p"))
    known = paths.select(scores.normal_path(F.col("path")).alias("p")).distinct().withColumn("found", F.lit(True))
    looked = flat.where("is_path").join(known, "p", "left").select("name", "ref", F.coalesce("found", F.lit(False)).alias("ok"))
    of_document = [c for c in ("name",) if c in names.columns]
    valid = names.select(*of_document, F.lower("entity").alias("low")).distinct().withColumn("found", F.lit(True))
    named = flat.where("not is_path").withColumn("low", F.lower("ref")).join(valid, [*of_document, "low"], "left").select("name", "ref", F.coalesce("found", F.lit(False)).alias("ok"))
    judged = looked.unionByName(named).groupBy("name").agg(F.count("*").alias("n_refs"), F.count_if("ok").alias("n_ok"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("ref")))).alias("invalid_references"))
    text = F.col("text")
    scored = docs.join(judged, "name", "left").select(
        "name",
        scores.entity_coverage(text, F.col("entities")).alias("entity_coverage"),
        F.coalesce(F.col("n_ok") / F.col("n_refs"), F.lit(1.0)).alias("factual_accuracy"),
        scores.conciseness(text).alias("conciseness"),
        scores.structural_completeness(text).alias("structural_completeness"),
        scores.judged_usefulness(text, judge).alias("usefulness"),
        scores.missing_entities(text, F.col("entities")).alias("missing_entities"),
        F.coalesce("invalid_references", F.array().cast("array<string>")).alias("invalid_references"),
    )
    return scored.withColumn("composite_score", scores.composite())


def report(evaluations: DataFrame) -> DataFrame:
    """One row of averages, rounded to four places, and totals."""
    means = [F.round(F.avg(c), 4).alias(f"avg_{c}") for c in [*scores.WEIGHTS, "composite_score"]]
    return evaluations.agg(F.count("*").alias("documents"), *means, F.coalesce(F.sum(F.size("missing_entities")), F.lit(0)).cast("long").alias("missing"), F.coalesce(F.sum(F.size("invalid_references")), F.lit(0)).cast("long").alias("invalid"))


def best_rank_by_file(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("file").agg(F.greatest(F.max("pagerank"), F.lit(0.0)).alias("rank"))


def mentioned(subjects: DataFrame, docs: DataFrame) -> DataFrame:
    """Subjects (subject) that some text of ``docs`` contains.

    An inverted index of the texts' grams, of those alone that some subject has: a
    subject with a gram that no text has is out; any other is looked up by its rarest
    gram, and the texts that hold this are searched.  Texts are read in blocks, so
    one without white space costs no more than any other; equal texts are read once.
    """
    keys = cut(subjects.select("subject").distinct().where("trim(subject) <> ''"))
    of_subject = keys.select("subject", F.explode(text_functions.grams_of_name(F.col("subject"))).alias("gram"))
    texts = cut(docs.where("text is not null").groupBy(F.sha2("text", 256).alias("doc")).agg(F.first("text").alias("text")))
    asked = of_subject.select("gram").distinct()
    seen = texts.select("doc", F.explode(text_functions.blocks(F.col("text"))).alias("block")).select("doc", F.explode(text_functions.grams(F.col("block"))).alias("gram"))
    postings = cut(seen.join(asked, "gram", "left_semi").distinct())
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = of_subject.join(counts, "gram", "left").groupBy("subject").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    candidates = rarest.where("r.n > 0").select("subject", F.col("r.gram").alias("gram")).join(postings, "gram").select("subject", "doc")
    found = candidates.join(texts, "doc").where(F.col("text").contains(F.col("subject"))).select("subject").distinct()
    return found


def gaps(files: DataFrame, entities: DataFrame, configs: DataFrame, docs: DataFrame) -> DataFrame:
    """(gap_type, subject, severity): files, entities and signalled configurations that no document mentions.

    files (path, rank), entities (name, pagerank), configs (path, signals).  A path
    is mentioned by its base name, which the whole path holds too.
    """
    found = files.select(F.lit("uncovered_file").alias("gap_type"), F.col("path").alias("subject"), F.least("rank", F.lit(1.0)).alias("severity"), basename(F.col("path")).alias("key"))
    found = found.unionByName(entities.select(F.lit("missing_entity").alias("gap_type"), F.col("name").alias("subject"), F.least("pagerank", F.lit(1.0)).alias("severity"), F.col("name").alias("key")))
    found = found.unionByName(configs.where("signals > 0").select(F.lit("orphan_config").alias("gap_type"), F.col("path").alias("subject"), F.least(0.2 * F.col("signals"), F.lit(1.0)).alias("severity"), basename(F.col("path")).alias("key")))
    told = mentioned(found.select(F.col("key").alias("subject")), docs)
    return found.join(told.withColumnRenamed("subject", "key"), "key", "left_anti").drop("key")


def ranked_gaps(found: DataFrame) -> DataFrame:
    """Gaps in report order: types by their worst, then by severity."""
    w = Window.partitionBy("gap_type")
    return found.withColumn("worst", F.max("severity").over(w)).orderBy(F.desc("worst"), "gap_type", F.desc("severity"), "subject")


def suggest_module(paths: DataFrame, module_files: DataFrame) -> DataFrame:
    """(path, module): the module that holds the path, else the one sharing most leading parts, else empty.

    Both sides are cut to directories and joined on each leading directory, so no
    pair without a common part is ever made.
    """
    own = paths.join(module_files, "path", "left").groupBy("path").agg(F.min("module").alias("own"))

    def heads(df: DataFrame, *keep: str) -> DataFrame:
        parts = F.split("path", "/")
        each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(F.split("path", "/"), 1, k), "/").alias("head")))
        return df.select(*keep, F.explode(each).alias("h")).select(*keep, "h.n", "h.head")

    per_head = heads(module_files, "module", "path").groupBy("head").agg(F.min("module").alias("near"))
    best = heads(own.where("own is null").select("path"), "path").join(per_head, "head").groupBy("path").agg(F.max_by("near", "n").alias("near"))
    return own.join(best, "path", "left").select("path", F.coalesce("own", "near", F.lit("")).alias("module"))
