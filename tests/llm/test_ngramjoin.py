import random
import re
from itertools import combinations

import numpy as np
import pytest

from quarry.llm import components, ngramjoin


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def classes(nodes, links):
    parent = {k: k for k in nodes}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {k: root(k) for k in nodes}


def plain(docs, n=4, percent=85):
    sets = {k: shingles(t, n) for k, t in docs}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = classes(sets, links)
    return {k: (len(s), comp[k]) for k, s in sets.items()}


def corpus(seed, common=True):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choices(vocab, k=25))
    out = [None, "", " \t\n", "one", "ONE", "one two", "a b c", "x y z w", "X y  z\nw", "x\x1cy z w v"]
    for _ in range(12):
        base = rng.choices(vocab, k=rng.randint(20, 150))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.3:
                copy += rng.choices(vocab, k=rng.randint(0, 20))
            out.append(" ".join(copy) + (" " + line if common and rng.random() < 0.5 else ""))
        out.append(out[-1])
    out += [line, line + " tail", " ".join(rng.choices(vocab, k=6000))]
    ids = rng.sample(range(10_000), len(out))
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 7)  # every group is split
    monkeypatch.setattr(ngramjoin, "FRONT", 5)
    docs = corpus(seed)
    df = spark.createDataFrame([(k, t, 1, "clash") for k, t in docs], "doc_id bigint, text string, n int, bits string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(df).collect()}
    assert got == plain(docs)


def test_near_copies_chain_in_one_class(spark):
    """A long chain of neighbours: each links with the next few only."""
    words = [f"v{k}" for k in range(400)]
    docs = [(k, " ".join(words[k * 4 : k * 4 + 120])) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(df).collect()}
    assert got == plain(docs) and {c for _, c in got.values()} == {0}


def test_repeated_rows_and_empty_tables(spark, no_documents):
    assert ngramjoin.join(no_documents).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (9, "z")]
    got = sorted(map(tuple, ngramjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(5, 3, 3), (5, 3, 3), (3, 3, 3), (None, 3, None), (9, 1, 9)], key=str)


def test_signature_trees_lose_no_pair(monkeypatch):
    monkeypatch.setattr(ngramjoin, "FRONT", 50)
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(15):
        base = rng.integers(0, 2**63, rng.integers(3, 300), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > 0.04], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(6)]
    sizes, maps, parts = np.asarray([len(s) for s in sets]), [ngramjoin.bitmap(s) for s in sets], np.arange(len(sets))
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - c)}

    def found(segment, left, right):
        trees = ngramjoin.SignatureTrees(np.asarray(segment), sizes, maps, parts, sizes)
        return [p for x, y in trees.pairs(np.asarray(left), np.asarray(right), 85) for p in zip(x.tolist(), y.tolist(), strict=True)]

    one = found([0] * 90, [0], [0])
    assert len(one) == len(set(one)) and want <= {tuple(sorted(p)) for p in one} and len(one) < 3 * len(want)
    two = found([0] * 40 + [1] * 50, [0, 0, 1], [0, 1, 1])  # two trees, with each other and with themselves
    assert sorted(map(tuple, map(sorted, two))) == sorted(map(tuple, map(sorted, one)))
    assert all(a < 40 <= b for a, b in found([0] * 40 + [1] * 50, [0], [1]))


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5400)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    nodes = {x for a, b in links for x in (a, b) if a != b}
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == classes(nodes, [(a, b) for a, b in links if a != b])
