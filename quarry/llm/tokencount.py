"""Token counts: batch encoding in an Arrow function that returns lengths only.

A text is split at its spaces and line feeds.  The vocabulary's normaliser
(canonical composition, white space to one space, lower case letter by letter)
and its pre-tokeniser (which drops white space and never joins across it) work
on each such piece alone, and no special token holds a space, so the count of a
text is the sum of its pieces' counts, however long the text is.  Each batch,
balanced by bytes, sends only its distinct new pieces to the tokenizer; a bounded
memo keeps the counts of earlier ones.

A piece without spaces is one call, however long.  A null or empty text has 0 tokens.  Repeated rows are counted alike; extra
columns are left out of the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import chunks

#: Characters of the pieces, and pieces, whose counts a worker keeps; it starts anew beyond either.
MEMO_CHARS, MEMO_PIECES = 16 << 20, 400_000
#: Bytes of distinct pieces in one call of the tokenizer.
CALL_BYTES = 1 << 18


def token_counts(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder, memo, held = Tokenizer.from_file(vocabulary), {}, 0
        for batch in chunks(batches, "text"):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            pieces = [t.replace("\n", " ").split(" ") for t in texts]
            new = set().union(*pieces).difference(memo)
            if len(memo) + len(new) > MEMO_PIECES or held > MEMO_CHARS:
                memo.clear()
                new, held = set().union(*pieces), 0
            held += sum(map(len, new))
            _count_new(encoder, new, memo)
            tokens = [sum(map(memo.__getitem__, p)) for p in pieces]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array(np.asarray(tokens, dtype=np.int64) > limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def _count_new(encoder, pieces: set[str], memo: dict[str, int]) -> None:
    """Add the token counts of ``pieces`` to ``memo``, in calls of about equal bytes."""
    call, size = [], 0
    for piece in pieces:
        call.append(piece)
        size += len(piece)
        if size >= CALL_BYTES:
            memo.update(zip(call, (len(e.ids) for e in encoder.encode_batch_fast(call, add_special_tokens=False)), strict=True))
            call, size = [], 0
    if call:
        memo.update(zip(call, (len(e.ids) for e in encoder.encode_batch_fast(call, add_special_tokens=False)), strict=True))
