"""Signals that people left in sources: markers, phrases, overrides, environment variables, docstrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (pattern, category) in order of precedence.
MARKERS = [("HACK", "hack"), ("WORKAROUND", "workaround"), ("XXX", "hack"), ("FIXME", "fixme"), ("TODO", "todo"), ("NOTE", "note"), ("IMPORTANT", "important"), ("WARNING", "warning")]
PHRASES = [
    (r"\bdeprecated\b", "deprecated"),
    (r"\bdo\s+not\s+remove\b", "important"),
    (r"\bdo\s+not\s+delete\b", "important"),
    (r"\bdo\s+not\s+change\b", "important"),
    (r"\bbackward\s+compat", "compatibility"),
    (r"\bserialization\b", "compatibility"),
    (r"\border\s+matters\b", "ordering"),
    (r"\bmust\s+be\s+before\b", "ordering"),
    (r"\bmust\s+be\s+after\b", "ordering"),
]
OVERRIDES = [(r"eslint-disable", "rule_override"), (r"type:\s*ignore", "rule_override"), (r"\bnoqa\b", "rule_override"), (r"pragma:\s*no\s*cover", "rule_override")]
ENV_PATTERNS = {
    "python": [r"""os\.environ\[["']([A-Za-z_][A-Za-z0-9_]*)["']\]""", r"""os\.environ\.get\(\s*["']([A-Za-z_][A-Za-z0-9_]*)["']""", r"""os\.getenv\(\s*["']([A-Za-z_][A-Za-z0-9_]*)["']"""],
    "javascript": [r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)", r"""process\.env\[["']([A-Za-z_][A-Za-z0-9_]*)["']\]"""],
    "go": [r"""os\.(?:Getenv|LookupEnv)\(\s*"([A-Za-z_][A-Za-z0-9_]*)\""""],
    "rust": [r"""(?:std::)?env::var(?:_os)?\(\s*"([A-Za-z_][A-Za-z0-9_]*)\"""", r"""env!\(\s*"([A-Za-z_][A-Za-z0-9_]*)\""""],
    "java": [r"""System\.getenv\(\s*"([A-Za-z_][A-Za-z0-9_.]*)\"""", r"""System\.getProperty\(\s*"([A-Za-z_][A-Za-z0-9_.]*)\""""],
}
ENV_PATTERNS["typescript"] = ENV_PATTERNS["javascript"]


def lines(df: DataFrame, text: str = "text", ends: str = r"\r?\n|\r") -> DataFrame:
    """One row per line with ``line_number`` from 1, cut at ``ends``; a last line feed ends a line and starts none."""
    parts = F.split(F.regexp_replace(F.col(text), r"\r?\n$", ""), ends)
    return df.select("*", F.posexplode(parts).alias("_pos", "line")).withColumn("line_number", F.col("_pos") + 1).drop("_pos")


def _first(line: Column, group: list[tuple[str, str]], form: str) -> Column:
    out = None
    for pattern, category in group:
        hit = line.rlike(form.format(pattern))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def line_signals(df: DataFrame, markers: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, overrides: list[tuple[str, str]] | None = None) -> DataFrame:
    """At most one signal a group and line, in the order marker, phrase, override: adds ``category`` and ``grp``; needs ``line``."""
    line = F.col("line")
    found = F.array(
        F.struct(F.lit(0).alias("grp"), _first(line, markers or MARKERS, r"\b{}\b").alias("category")),
        F.struct(F.lit(1).alias("grp"), _first(line, phrases or PHRASES, r"(?i){}").alias("category")),
        F.struct(F.lit(2).alias("grp"), _first(line, overrides or OVERRIDES, "{}").alias("category")),
    )
    hit = F.filter(found, lambda s: s["category"].isNotNull())
    return df.select("*", F.explode(hit).alias("_s")).select(*df.columns, "_s.grp", "_s.category").withColumn("line_content", F.trim(line))


def env_vars(text: Column, patterns: list[str]) -> Column:
    """Distinct names in order of first appearance, pattern by pattern."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))))


def has_module_docstring(text: Column, lang: Column) -> Column:
    head = F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    return (
        F.when(lang == "go", head.startswith("// Package "))
        .when(lang == "rust", head.startswith("//!"))
        .when(lang == "java", head.startswith("/**"))
        .otherwise(head.startswith('"""') | head.startswith("'''"))
    )


def around(column: str, before: int, after: int, key: str = "path", order: str = "line_number") -> Column:
    """The lines from ``before`` to ``after`` of the current one, joined: the frame of annotation look-arounds."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(before, after)
    return F.array_join(F.collect_list(column).over(w), "\n")
