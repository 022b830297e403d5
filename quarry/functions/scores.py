"""Scores of generated documents as column arithmetic."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import backtick_references, normal_path

# Fixed values.
SECTIONS = ["Quick Commands", "Key Files", "Non-Obvious Patterns", "See Also"]
USEFUL = ["because", "since", "ensures", "otherwise", "prevents", "gotcha", "breaks if", "must be", "never", "always"]
USELESS = ["parameter", "returns a", "takes a", "type:"]
VERBOSE = [r"(?m)^\s*def\s+\w+\(", r"(?mi)^\s*[-*]\s*`?\w+`?\s*[-:].*(?:parameter|param|arg)", r"(?m)^```", r"(?m)^\s*\w+\s*:\s*\w+"]
WEIGHTS = {"factual_accuracy": 0.30, "entity_coverage": 0.25, "conciseness": 0.20, "structural_completeness": 0.10, "usefulness": 0.15}
CRITIC_WORDS = ["because", "since", "this ensures", "otherwise", "gotcha"]
PATH_ENDINGS = [".py", ".ts", ".js", ".go", ".rs", ".java"]


def _share(part: Column, whole: Column) -> Column:
    """part / whole, and 1 when there is nothing to share."""
    return F.when(whole == 0, 1.0).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)))


def missing_entities(text: Column, names: Column) -> Column:
    return F.filter(names, lambda n: ~F.lower(text).contains(F.lower(n)))


def entity_coverage(text: Column, names: Column) -> Column:
    return _share(F.size(names) - F.size(missing_entities(text, names)), F.size(names))


def looks_like_path(ref: Column) -> Column:
    return ref.contains("/") | ref.rlike("(" + "|".join(e.replace(".", r"\.") for e in PATH_ENDINGS) + ")$")


def invalid_references(text: Column, names: Column, paths: Column) -> Column:
    """Backticked references that name neither an entity nor, if they look like paths, a file."""
    known, low = F.transform(paths, normal_path), F.transform(names, F.lower)
    wrong = lambda r: F.when(looks_like_path(r), ~(F.array_contains(known, normal_path(r)) | F.array_contains(paths, r))).otherwise(~F.array_contains(low, F.lower(r)))
    return F.filter(backtick_references(text), wrong)


def factual_accuracy(text: Column, names: Column, paths: Column) -> Column:
    total = F.size(backtick_references(text))
    return _share(total - F.size(invalid_references(text, names, paths)), total)


def _lines(text: Column) -> Column:
    return F.size(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"))


def verbose_hits(text: Column) -> Column:
    return F.array(*(F.regexp_count(text, F.lit(p)) for p in VERBOSE))


def conciseness(text: Column, most: int = 35) -> Column:
    """1 up to ``most`` lines, 0.5 at twice that and falling; less 0.15 for each verbose pattern hit over twice."""
    n = _lines(text).cast("double")
    base = F.when(n <= most, 1.0).when(n <= 2 * most, 1.0 - 0.5 * (n - most) / most).otherwise(F.greatest(F.lit(0.2), 0.5 - 0.1 * (n - 2 * most) / most))
    penalty = F.aggregate(verbose_hits(text), F.lit(0.0), lambda acc, h: acc + F.when(h > 2, F.least(F.lit(0.15), h * 0.05)).otherwise(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty))


def structural_completeness(text: Column) -> Column:
    return sum((F.lower(text).contains(s.lower()).cast("int") for s in SECTIONS), F.lit(0)) / float(len(SECTIONS))


def usefulness(text: Column) -> Column:
    low = F.lower(text)
    good, bad = (sum((low.contains(w).cast("int") for w in words), F.lit(0)) for words in (USEFUL, USELESS))
    raw = 0.3 + 0.7 * F.least(F.lit(1.0), good / 4.0) - F.least(F.lit(0.3), bad * 0.075)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def judged_usefulness(text: Column, judge: Callable[[str], float | None] | None = None) -> Column:
    """Usefulness by an injected judge, held to [0, 1]; the heuristic where there is none, or it fails or gives nothing."""
    if judge is None:
        return usefulness(text)

    @F.pandas_udf("double")
    def asked(texts: pd.Series) -> pd.Series:
        def one(t: str) -> float | None:
            try:
                score = judge(t)
                return None if score is None else min(1.0, max(0.0, float(score)))
            except Exception:  # a judge is a remote service; one document must not end the evaluation
                return None

        return pd.Series([one(t) if t is not None else None for t in texts], dtype="float64")

    return F.coalesce(F.nanvl(asked(text), F.lit(None).cast("double")), usefulness(text))


def composite(score: dict[str, Column] | None = None) -> Column:
    return sum(((score[k] if score else F.col(k)) * w for k, w in WEIGHTS.items()), F.lit(0.0))


def critic_conciseness(text: Column) -> Column:
    n = _lines(text)
    return F.when(n <= 35, 1.0).when(n <= 45, 1.0 - 0.05 * (n - 35)).otherwise(0.3)


def critic_accuracy(text: Column) -> Column:
    return F.when((_lines(text) >= 5) & (structural_completeness(text) >= 0.75), 1.0).otherwise(0.6)


def critic_coverage(text: Column, names: Column, known: Column) -> Column:
    """Mentioned share of the top entities (0.8 without any), averaged with the share of known lines that the draft takes up."""
    low = F.lower(text)
    base = F.when(F.size(names) == 0, 0.8).otherwise(entity_coverage(text, names))
    told = F.filter(known, lambda t: F.exists(F.split(F.lower(t), r"\s+"), lambda w: (F.length(w) > 4) & low.contains(w)))
    return F.when(F.size(known) > 0, (base + F.size(told) / F.nullif(F.size(known), F.lit(0))) / 2).otherwise(base)


def critic_usefulness(text: Column) -> Column:
    hits = sum((F.lower(text).contains(w).cast("int") for w in CRITIC_WORDS), F.lit(0))
    return F.least(F.lit(1.0), 0.5 + 0.1 * hits + 0.3 * structural_completeness(text))


def gate(score: Column, iteration: Column, previous: Column) -> Column:
    """``pass`` at a good score, after three rounds, or when two rounds gained little; else ``fix``."""
    s, i, p = (F.coalesce(c, F.lit(0)) for c in (score, iteration, previous))
    return F.when((s >= 0.85) | (i >= 3) | ((i >= 2) & (s - p < 0.02)), "pass").otherwise("fix")
