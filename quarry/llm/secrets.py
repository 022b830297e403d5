"""Secret scans: base patterns and a token-efficiency test.

Base kinds are found by pattern (see ``BASE``).  The test then takes every
maximal run of 20 or more key characters that holds letters and digits, and
divides its characters by its tokens under a tiktoken vocabulary: text that the
vocabulary was made for has many characters a token, random strings few.  Runs
at or under ``threshold`` become spans of kind ``random``, unless they are
known digests (hex of the length of a common digest, not inside a base span) or
identifiers (UUIDs, digits alone, words joined by ``_ - / .``), or overlap a
base span.

Offsets are code points, end exclusive.  A null text is empty and has no spans;
long texts are read whole, in time about linear in their length; repeated rows
get equal results; extra columns are never read; an empty table gives an empty
result.  Of spans that begin together, the kinds come in the order listed.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import chunks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more is the same as a maximal run filtered by its length
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ["assign", "access", "hex", "random"]
BASE = KINDS[:3]
#: Characters of hex digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = [32, 40, 56, 64, 96, 128]
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
LETTERS = re.compile(r"[A-Za-z]+")
CASES = re.compile(r"([A-Z]*)([a-z]*)")
THRESHOLD = 2.2


@lru_cache(maxsize=2)
def encoder(ranks: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _worded(letters: str) -> bool:
    """Whether a run of letters is made of words: three or more letters in one case, or a capital and two or more small ones."""
    for m in CASES.finditer(letters):
        capitals, small = len(m[1]), len(m[2])
        alone = capitals in (0, 3) or capitals > 3  # capitals that are a word, or none
        led = capitals == 1 or capitals > 3  # the last capital begins the small word
        if small and not (alone and small >= 3 or led and small >= 2) or capitals and not small and capitals < 3:
            return False
    return True


def identifier(run: str) -> bool:
    """Whether a run is words and numbers, joined by ``_ / + = -`` or not at all; one pass, as runs can be very long."""
    return run[0] not in "_/+=-" and all(_worded(m[0]) for m in LETTERS.finditer(run))


def excluded(run: str) -> bool:
    """Whether a run is a known digest or an identifier."""
    return bool(UUID.fullmatch(run)) or (len(run) in DIGEST_LENGTHS and bool(HEX_ONLY.fullmatch(run))) or identifier(run)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base kinds, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], ranks: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Runs that take many tokens for their length and touch no base span."""
    out, starts, reach = [], [s for s, _, _ in base], [0, *accumulate((e for _, _, e in base), max)]
    for m in RUN.finditer(text):
        run, a, b = m[0], m.start(), m.end()
        if not (any(map(str.isdigit, run)) and any(map(str.isalpha, run))) or reach[bisect_left(starts, b)] > a or excluded(run):
            continue
        if len(run) <= threshold * len(encoder(ranks).encode_ordinary(run)):
            out.append((a, 3, b))
    return out


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, ranks: str, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_assign, n_access, n_hex, n_random, base_sha256 and spans of each row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                extra = random_spans(text, base, ranks, threshold) if text else []
                n = [sum(k == j for _, k, _ in base) for j in range(3)]
                rows.append((*n, len(extra), sha256(_text(base).encode()).hexdigest(), _text(sorted(base + extra))))
            cols = zip(*rows, strict=True)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"
    return rows.mapInArrow(find, schema).withColumnRenamed("id", id_col)
