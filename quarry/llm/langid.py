"""Language ID by hierarchical discrimination.

A linear support vector machine per family, one against the rest, picks the
language family; then one-versus-one machines vote among the languages of that
family.  Features are hashed counts of 1 to 3 bytes of the lower-cased UTF-8
text, damped by a square root and scaled to unit length.

The models are fitted on the driver on a bounded sample of labelled rows: at
most about ``per_language`` documents of each language of at most
``longest_sample`` characters, picked by a hash of the id; rows of one id are taken or left together.
Predictions see the whole text and nothing else.

A null text, and a text without any letter, is ``und`` with score 0, as is every
text when no labelled row exists.  Ties go to the alphabetically first family or
language.  Repeated rows get equal results; other columns are never read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import chunks

UNDETERMINED = "und"
DIMENSIONS = 4096
#: Families of the commoner ISO 639-1 codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "nb", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk"],
    "indic": ["hi", "bn", "mr", "ur"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_ROWS_AT_ONCE = 256


def features(texts: list[str]) -> np.ndarray:
    """One unit vector of hashed byte n-grams (1 to 3) per text."""
    parts = [b" " + t.lower().encode("utf-8", "replace") + b"  " for t in texts]
    offsets = np.cumsum([0, *map(len, parts)])
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(parts), dtype=np.int64) * DIMENSIONS, np.diff(offsets))
    grams = np.full(len(data), 1, dtype=np.uint32)
    counts = np.zeros(len(parts) * DIMENSIONS)
    with np.errstate(over="ignore"):
        for n in range(3):
            grams = grams[: len(data) - n] * np.uint32(257) + data[n:]
            slot = (grams * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(row[: len(slot)] + slot, minlength=len(counts))
    x = np.sqrt(counts.reshape(len(parts), DIMENSIONS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = z = np.zeros(x.shape[1], dtype=np.float32)
    step = 0.2
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        after = z - step * (penalty * z - 2 * (x.T @ (share * y * slack)))
        z = after + k / (k + 3) * (after - w)
        w = after
    return w


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray
    members: dict[str, list[str]]
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = x @ self.family_weights.T
        best = np.argmax(margins, axis=1)
        score = _squash(margins[np.arange(len(x)), best]) if len(self.families) > 1 else np.ones(len(x))
        out = np.empty(len(x), dtype=object)
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            codes = self.members[family]
            votes = np.zeros((len(rows), len(codes)))
            support = np.zeros((len(rows), len(codes)))
            for (i, a), (j, b) in combinations(enumerate(codes), 2):
                p = _squash(x[rows] @ self.pair_weights[a, b])
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                support[:, i] += p
                support[:, j] += 1 - p
            pick = np.argmax(votes, axis=1)
            out[rows] = np.asarray(codes, dtype=object)[pick]
            if len(codes) > 1:
                score[rows] *= support[np.arange(len(rows)), pick] / (len(codes) - 1)
        return out.tolist(), np.clip(score, 0, 1)


def _squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4.0 * np.clip(margin.astype(np.float64), -20, 20)))


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """Fit on labelled texts; None without any."""
    if not texts:
        return None
    x = np.vstack([features(texts[k : k + _ROWS_AT_ONCE]) for k in range(0, len(texts), _ROWS_AT_ONCE)])
    lang = np.asarray(langs, dtype=object)
    members: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        members.setdefault(_FAMILY_OF.get(code, f"own:{code}"), []).append(code)
    families = sorted(members)
    family = np.asarray([_FAMILY_OF.get(c, f"own:{c}") for c in langs], dtype=object)
    weights = np.vstack([_fit_svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in families])
    pairs = {}
    for codes in members.values():
        for a, b in combinations(codes, 2):
            rows = np.flatnonzero((lang == a) | (lang == b))
            pairs[a, b] = _fit_svm(x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32))
    return Model(families, weights, members, pairs)


def train(df: DataFrame, *, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, longest_sample: int = 20_000) -> Model | None:
    """Fit on a bounded sample of the rows with text and language for which ``where`` holds.

    About ``per_language`` rows a language; a text of over ``longest_sample``
    characters takes part with a stretch of that many, at a place picked by its id.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if where is None else where).alias("use"))
    rows = rows.where("use and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    buckets = 1 << 20
    share = F.create_map([F.lit(x) for code, n in sizes.items() for x in (code, min(buckets, -(-buckets * per_language // n)))])
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(buckets)) < share[F.col("lang")])
    start = F.pmod(F.xxhash64("id", F.lit(13)), F.greatest(F.length("text") - longest_sample + 1, F.lit(1))).cast("int") + 1
    sample = sample.select("id", F.substring("text", start, F.lit(longest_sample)).alias("text"), "lang").collect()
    sample.sort(key=lambda r: (str(r["id"]), r["text"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(df: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred and score of each row."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            for lo in range(0, chunk.num_rows, _ROWS_AT_ONCE):
                batch = chunk.slice(lo, _ROWS_AT_ONCE)
                texts = batch.column(1).to_pylist()
                langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                seen = [k for k, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
                if seen:
                    found, score = model.predict(features([texts[k] for k in seen]))
                    scores[seen] = score
                    for k, code in zip(seen, found, strict=True):
                        langs[k] = code
                yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
