import random
from hashlib import sha256

import numpy as np
import pytest

from quarry.llm import suffixdedup as sd


def plain(docs, length=50):
    first = {}
    for doc, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], doc)
    out = []
    for doc, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if doc is not None and first[b[k : k + length]] < doc:
                gone[k : k + length] = True
        edges = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((doc, len(b), int(gone.sum()), edges, sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "été", "thwh", "the", "of", "ing", "漢字", "re"]
    passages = [" ".join(rng.choices(words, k=rng.randint(6, 40))) for _ in range(8)]
    docs = []
    for _ in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 15))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        docs.append(" ".join(parts))
    docs += [None, "", "short", "short", docs[0], docs[0], "ab" * 300, "ab" * 200, "b" + "ab" * 40, "x" * 49, "x" * 50, "x" * 50, "y" + "x" * 51, "z" * 20000]
    ids = rng.sample(range(1000), len(docs))
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize(("seed", "hot", "q"), [(1, 4 << 20, sd.GRAM), (2, 300, sd.GRAM), (3, 4 << 20, 3)])
def test_equals_brute_force(spark, seed, hot, q, monkeypatch):
    monkeypatch.setattr(sd, "HOT_BYTES", hot)
    monkeypatch.setattr(sd, "REFINE_BYTES", 700)
    docs = corpus(seed)
    docs += [(docs[2][0], docs[5][1]), docs[7], (None, docs[0][1])]  # equal ids, a repeated row, no id
    df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id bigint, text string, key int, spans string")
    got = [tuple(r)[:5] for r in sd.dedup(df, q=q).collect()]
    assert sorted(got, key=str) == plain(docs)


def test_empty_table(spark, no_documents):
    assert sd.dedup(no_documents).count() == 0


@pytest.mark.parametrize("q", [1, 3, 5, 8])
def test_refinement_equals_grouping_by_bytes(q):
    rng = random.Random(q)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 400))) for _ in range(12)] + [b"a" * 300]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts, bucket = sd.refine(data, offsets, 50, q)
    raw = data.tobytes()
    by_bytes, by_bucket = {}, {}
    for s, b in zip(starts.tolist(), bucket.tolist(), strict=True):
        by_bytes.setdefault(raw[s : s + 50], set()).add(s)
        by_bucket.setdefault(b, set()).add(s)
    assert sorted(map(sorted, by_bytes.values())) == sorted(map(sorted, by_bucket.values()))
    assert len(starts) == sum(max(0, len(t) - 49) for t in texts)
