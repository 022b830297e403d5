import random
import re
import tracemalloc
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa

from quarry.llm import _base, decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, width=10):
    out = {}
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - width + 1) if v else 0):
                phrase = v[k : k + width]
                for a in range(len(w) - len(phrase) + 1):
                    if w[a : a + len(phrase)] == phrase:
                        hit |= set(range(a, a + len(phrase)))
                        ids.add(str(item))
        out[doc] = (len(w), sorted(hit), sorted(ids))
    return out


def cases():
    rng = random.Random(2)
    vocab = ["a", "B", "cé", "d4", "É", "x"]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate([12, 10, 3, 0, 25, 12])] + [(9, None), (10, "!!"), (11, "a B cé"), (100, "É-x;d4")]
    items.append((12, items[0][1]))
    docs = [(0, None), (1, ""), (2, items[0][1].upper()), (3, "zz " + items[4][1] + " zz"), (4, "a b"), (5, items[1][1] + " " + items[1][1])]
    docs += [(k, " ".join(rng.choices(vocab, k=60))) for k in range(6, 20)] + [(20, docs[2][1])]
    return docs, items


def test_equals_brute_force_in_one_part_and_in_many(spark):
    docs, items = cases()
    want = plain(docs, items)
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id bigint, text string, item_id string, hits int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for part_windows in (1_000_000, 20):
        got = {r.doc_id: (r.n_words, list(r.hit_words), list(r.item_ids)) for r in decontam.find(df, bench, part_windows=part_windows).collect()}
        assert got == want
    clean = decontam.find(df, bench.limit(0)).collect()
    assert len(clean) == len(docs) and all(r.n_hit == 0 for r in clean)
    assert decontam.find(df.limit(0), bench).count() == 0
    assert decontam.digest([]) == sha256(b"").hexdigest()


def block_of(texts, gap):
    hashes, row, counts = decontam.words_of(pa.array(texts))
    terms = np.unique(hashes)
    return decontam.Postings(terms, [np.flatnonzero(hashes == t) + row[hashes == t] * gap for t in terms])


def test_hits_of_a_block():
    post = block_of(["blue x red y green", "green q q q q q q red blue", "red green", "red green blue red green blue", "red"], 11)
    phrase = decontam.words_of(pa.array(["red green blue"]))[0].tolist()
    for order in ([0, 1, 2], [2, 0, 1]):  # any term may be the rarest
        test = decontam.Windows([7], [[phrase[k] for k in order]], [order])
        assert decontam.proximity_hits(post, test, 6)[0] == (0, 0, 4)
        window, at = decontam.phrase_hits(post, test)
        assert window.tolist() == [0, 0] and sorted((at - at.min()).tolist()) == [0, 3]
    assert len(decontam.phrase_hits(post, decontam.Windows([1], [[phrase[0], 5]], [[0, 1]]))[0]) == 0


def test_index_rows(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (None, "b c"), (1, "a b a")], "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    held = decontam.item_windows(bench, 10, "item_id", "text")
    rows = decontam.build_index(df, decontam.term_bitmap(held), 11).collect()
    docs = sorted((r.ordinal, r.id, r.n_words) for r in rows if r.ordinal is not None)
    assert docs == [(0, 1, 3), (1, 2, 0), (2, None, 2), (3, 1, 3)]
    got = {tuple(np.frombuffer(r.positions, "<i4").tolist()) for r in rows if r.kind == decontam.POSTINGS}
    assert got == {(0, 2, 38, 40), (1, 25, 39)}  # the word outside the test is not stored


def test_very_long_and_common_texts(spark):
    phrase = " ".join(f"w{k}" for k in range(10))
    docs = [(0, "the " * 400_000 + phrase + " the" * 400_000), *((k, "the of " * 20 + phrase) for k in range(1, 400)), *((k, "the of and") for k in range(400, 800))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame([(1, phrase), (2, "the " * 10), (3, "the of the of")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontam.find(df, bench).collect()}
    assert len(got) == 800 and got[0].n_hit == 800_010 and got[0].item_ids == ["1", "2"]
    assert all(got[k].item_ids == ["1", "3"] and got[k].n_hit == 50 for k in range(1, 400)) and not any(got[k].n_hit for k in range(400, 800))


def plain_near(docs, items, span, width=10):
    out = {}
    for doc, text in docs:
        w, ids, near = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - width + 1) if v else 0):
                need = Counter(v[k : k + width])
                for a in range(len(w)):
                    for z in range(a, min(a + span, len(w))):
                        if not need - Counter(w[a : z + 1]):
                            if w[a] in need:
                                ids.add(str(item))
                                if w[a] in need:
                                    near |= set(range(a, z + 1))
                            break
        out[doc] = (sorted(ids), sorted(near))
    return out


def test_find_returns_proximity_matches(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate([12, 10, 3, 0, 2])] + [(9, None)]
    docs = [(0, None), (1, "")]
    for k in range(2, 40):
        v = words(items[k % 5][1])
        rng.shuffle(v)
        docs.append((k, " ".join(rng.choices(vocab, k=15) + [x for t in v for x in (t, *rng.choices(vocab, k=k % 2))] + rng.choices(vocab, k=15))))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for part_windows in (1_000_000, 20):
        got = {r.doc_id: (list(r.near_item_ids), list(r.near_words)) for r in decontam.find(df, bench, span=20, part_windows=part_windows).collect()}
        assert got == plain_near(docs, items, 20)
    assert sum(bool(x[0]) for x in got.values()) > 20


def test_proximity_of_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "one two three four", "x", 5), (2, None, "y", 6)], "doc_id bigint, text string, item_id string, n_words bigint")
    bench = spark.createDataFrame([("a", "two four", 1)], "item_id string, text string, doc_id bigint")
    got = {r.doc_id: (r.n_words, list(r.near_item_ids), list(r.near_words)) for r in decontam.find(df, bench, span=20).collect()}
    assert got == {1: (4, ["a"], [1, 2, 3]), 2: (0, [], [])}
    none = decontam.find(df, bench.limit(0), span=20).collect()
    assert all(not r.near_item_ids and not r.near_words for r in none) and len(none) == 2
    assert decontam.find(df.limit(0), bench, span=20).count() == 0


def test_hashing_words_takes_bounded_memory(monkeypatch):
    """Two megabytes of texts, as a block of the index has them, are hashed in parts; the parts change no hash."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, n)) for n in rng.integers(0, 500, 1000)]
    column = pa.array([*texts, None, "", "Ab-cd"])
    decontam.words_of(column.slice(0, 10))
    tracemalloc.start()
    got = decontam.words_of(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6, peak
    monkeypatch.setattr(_base, "HASH_BYTES", 1 << 30, raising=False)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, decontam.words_of(column), strict=True))
    assert got[2].tolist()[-3:] == [0, 0, 2] and got[2].sum() == len(got[0]) == len(got[1])
