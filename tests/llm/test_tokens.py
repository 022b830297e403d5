"""Packing, token counts and secrets against the libraries and brute force."""

import random
import re
import time
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import SF
from tokenizers import Tokenizer

from quarry.llm import packing, queries, secrets, tokencount

WORD, BYTE, RANKS = (str(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def test_token_counts_equal_the_library(spark, documents):
    encoder = Tokenizer.from_file(WORD)
    for df in (documents, spark.read.parquet(f"{SF}/documents.parquet")):
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(df, WORD).collect()}
        for r in df.collect():
            n = len(encoder.encode(r.text or "", add_special_tokens=False).ids)
            assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 2048)


def test_token_counts_split_is_safe_for_odd_characters(spark):
    encoder, rng = Tokenizer.from_file(WORD), random.Random(3)
    odd = ["́", " ", "\n", "\r", "\x1c", " ", " ", "\u0085", "É", "ß", "Σ", "ς", "İ", "'s", "'", "<|startoftext|>", "<|endoftext|>", "<|", "7", "漢", "a", "﻿", "‍"]
    texts = ["".join(rng.choices(odd, k=12)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(df, WORD).collect()}
    assert got == {k: len(encoder.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_token_counts_of_long_pieces_and_empty_tables(spark, no_documents, monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO_CHARS", 50)
    encoder = Tokenizer.from_file(WORD)
    texts = ["x" * 300_000, "ab" * 1000 + " 12", "a b c " * 500, "漢字" * 2000, "x" * 300_000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int").coalesce(1)
    got = {r.doc_id: r.n_tokens for r in tokencount.token_counts(df, WORD).collect()}
    assert got == {k: len(encoder.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert tokencount.token_counts(no_documents, WORD).count() == 0


def check_packing(df, got):
    encoder = Tokenizer.from_file(BYTE)
    sequences, pieces = defaultdict(list), defaultdict(list)
    ids = {r.doc_id: [*encoder.encode(r.text or "", add_special_tokens=False).ids, 0] for r in df.collect()}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(own) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.asarray(own, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length))
    for doc, spans in pieces.items():
        assert sum(n for _, n in spans) == len(ids[doc])
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:]))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][0] + spans[-1][1] <= 1024
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert set(pieces) == set(ids)
    return 1 - sum(n for s in sequences.values() for _, n in s) / (1024 * len(sequences))


def test_packing_holds_each_id_once(spark, documents, no_documents):
    check_packing(documents, packing.pack(documents, BYTE, RANKS, group_docs=20).collect())
    assert packing.pack(no_documents, BYTE, RANKS).count() == 0
    padding = check_packing(spark.read.parquet(f"{SF}/documents.parquet"), queries.op1_packing(spark, SF).collect())
    assert padding < 0.01


def test_packing_of_repeated_and_missing_ids(spark):
    rows = [(1, "one two three", "x"), (1, "one two three", "x"), (1, "other words", "x"), (None, "no id", "x"), (None, "no id", "x"), (2, None, "x"), (3, "", "x"), (4, "long " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sequence_id string")
    got = packing.pack(df, BYTE, RANKS, group_docs=3).collect()
    encoder = Tokenizer.from_file(BYTE)
    want = sum(len(encoder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    spans = defaultdict(list)
    for r in got:
        spans[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == want
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and sum(n for _, n in s) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:]))


def test_packing_of_a_table_of_equal_rows(spark):
    rows = spark.createDataFrame([(1, "same text here", "en", "s", 14)] * 700, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = packing.pack(rows, BYTE, RANKS).collect()
    n = len(Tokenizer.from_file(BYTE).encode("same text here", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got) == 700 * n and {r.doc_tokens for r in got} == {n}
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    ends = {}
    for seq, offset, length in places:
        assert offset == ends.get(seq, 0)
        ends[seq] = offset + length
    assert max(ends.values()) <= 1024 and len(ends) == -(-700 * n // 1024)


def test_both_libraries_agree_on_long_mixed_texts():
    slow, fast, rng = Tokenizer.from_file(BYTE), packing._encoder(BYTE, RANKS), random.Random(31)
    bits = ["'s", "'ll", "don't", " ", "  ", "\n", "\t ", "\u00a0", "é", "Æ", "ß", "123", "a1", "_", "-", "<|endoftext|>", "<|", "wörd", "X" * 40, "\r\n", "$%&", "\u00ad"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 25)))
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids, text


def test_first_fit_decreasing_equals_a_plain_one():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 100, rng.integers(1, 60))
        plain, room = [], []
        for k in np.argsort(-lengths, kind="stable").tolist():
            for b in range(len(plain)):
                if room[b] >= lengths[k]:
                    break
            else:
                plain.append([])
                room.append(100)
                b = len(plain) - 1
            plain[b].append(k)
            room[b] -= lengths[k]
        assert packing.first_fit_decreasing(lengths, 100) == plain


@pytest.mark.parametrize("pattern", ["{0}", "a{0}a", " {0} ", "{0}{0} b", "1{0}\n{0}"])
def test_both_libraries_agree_on_common_code_points(pattern):
    slow, fast = Tokenizer.from_file(BYTE), packing._encoder(BYTE, RANKS)
    for c in range(1, packing.COMMON_BELOW):
        text = pattern.format(chr(c))
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids, hex(c)


def plain_base_spans(text):
    """The contract, read literally."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets_base_equals_the_contract(spark):
    rng = random.Random(9)
    bits = ["password", "PassWd", "token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", ".", "é", "ſecret", "x", "\n", "secret"]
    texts = ["".join(rng.choices(bits, k=14)) for _ in range(3000)] + ["", "token=secret: abcdefghijklmnop"]
    for t in texts:
        assert secrets.base_spans(t) == plain_base_spans(t), t
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in secrets.scan(df, RANKS).collect()}
    assert got[None].spans == "" and len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        assert got[k].n_assign == sum(s[1] == 0 for s in plain_base_spans(t))


def test_identifiers_equal_their_pattern():
    pattern = re.compile(r"(?:(?:[A-Za-z][a-z]{2,}|[A-Z]{3,}|[0-9]{1,4})[_/+=-]*)+")
    rng = random.Random(12)
    for _ in range(20000):
        run = "".join(rng.choices(["a", "bc", "def", "G", "HI", "JKL", "MNOP", "1", "23456", "_", "-"], k=rng.randint(1, 6)))
        assert secrets.identifier(run) == bool(pattern.fullmatch(run)), run


def plain_spans(text, threshold=secrets.THRESHOLD):
    """All spans, read literally: a run is judged against every base span, one by one."""
    base, out = plain_base_spans(text), []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        a, b = m.span()
        mixed = re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
        if mixed and not any(s < b and a < e for s, _, e in base) and not secrets.excluded(m[0]) and len(m[0]) <= threshold * len(secrets.encoder(RANKS).encode_ordinary(m[0])):
            out.append((a, 3, b))
    return base, sorted(base + out)


def test_query_of_secrets_equals_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_secrets(spark, SF).collect()}
    assert set(got) == set(docs)
    for k, text in docs.items():
        base, spans = plain_spans(text)
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(s[1] == j for s in base) for j in range(3))
        assert got[k].base_sha256 == sha256(secrets._text(base).encode()).hexdigest()
        assert got[k].spans == secrets._text(spans)


def test_secrets_of_long_texts_repeated_rows_and_odd_tables(spark):
    began = time.monotonic()
    rng = random.Random(2)
    long = ["b" * 1_000_000, "z" * 1_000_000 + "1Bc", "aB" * 300_000 + "1", "0123456789abcdef " * 60_000, "token=abcdefghijkl1 x9QpL2vTz7RmK4wYb8NcJ3 " * 20_000, "".join(rng.choices("abcXYZ019", k=1_000_000)), " " * 1_000_000 + "token" + " " * 500_000]
    df = spark.createDataFrame([*[(k, t, "clash") for k, t in enumerate(long)], (90, "AKIAABCDEFGHIJKLMN", "x"), (90, "AKIAABCDEFGHIJKLMN", "x"), (91, None, None), (92, "", "")], "doc_id bigint, text string, spans string")
    rows = secrets.scan(df, RANKS).collect()
    got = {r.doc_id: r for r in rows}
    assert time.monotonic() - began < 60
    assert [r.spans for r in rows if r.doc_id == 90] == ["access:0:18"] * 2
    assert got[3].n_hex == 60_000 and got[4].n_assign == 20_000 and got[4].n_random == 20_000 and got[91].spans == got[92].spans == ""
    assert secrets.scan(df.limit(0), RANKS).count() == 0


def test_secrets_random_strings_but_no_words_digests_or_ids():
    def kinds(text):
        return secrets.random_spans(text, secrets.base_spans(text), RANKS)

    assert kinds("key x9QpL2vTz7RmK4wYb8NcJ3 end") == [(4, 3, 26)]
    for clean in ("internationalisation_of_words_2024", "550e8400-e29b-41d4-a716-446655440000", "D41D8CD98F00B204E9800998ECF8427E", "just some plain words here", "path/to/some/module/name_v2"):
        assert kinds(clean) == [], clean
