import math
import random

import numpy as np
from tests.llm.test_ngramjoin import classes

from quarry.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector string"


def plain(rows, threshold=0.93):
    good = [(k, np.asarray(np.float32(v), dtype=np.float64), lab) for k, v, lab in rows if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for i, (k, v, lab) in enumerate(good):
        for j, w, lab2 in good[i + 1 :]:
            if lab == lab2 and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= threshold:
                links.append((k, j))
    comp = classes([r[0] for r in rows], links)
    n = dict.fromkeys(comp, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {k: (n[k], comp[k], comp[k] == k) for k in comp}, links


def corpus(n, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 6)):
            noise = rng.normal(size=dim)
            noise *= rng.uniform(0, 0.45) * np.linalg.norm(base) / np.linalg.norm(noise)
            out.append(((base + noise) * rng.uniform(0.5, 2)).astype(np.float32).tolist())
    rows = [(k, v, int(rng.integers(0, 2))) for k, v in enumerate(out)]
    return [(int(k), v, lab) for k, (_, v, lab) in zip(rng.permutation(len(rows)), rows, strict=True)]


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}


def test_odd_vectors_and_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBER_BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 24)
    rows = corpus(150)
    k = 10_000
    for v in (None, [], [0.0] * 24, [1.0, None] * 12, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.1], [3e38, 3e38], [3e38, 3e38], rows[3][1], rows[3][1], rows[3][1]):
        rows.append((k, v, rows[3][2]))
        k += 1
    rows += [(k, rows[3][1], None), (k + 1, rows[3][1], 1 - rows[3][2])]
    assert got(spark, rows) == plain(rows)[0]
    df = spark.createDataFrame([], SCHEMA)
    assert vectors.near_duplicates(df).count() == 0


def test_recall_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 6)
    rows = corpus(3000, dim=48, seed=4)
    assert vectors.lists_for(len(rows)) == 500
    want, links = plain(rows)
    found = got(spark, rows)
    assert all(found[k][0] <= want[k][0] for k in want)
    assert sum(f[0] for f in found.values()) % 2 == 0  # no link counts for one end only
    assert sum(f[0] for f in found.values()) >= 0.97 * 2 * len(links)
    assert np.mean([found[k][1] == want[k][1] for k in want]) > 0.97


def test_codes_lose_no_neighbour_of_a_list():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = vectors.Model.fit(x, 4, 6, 16)
    lists, codes, error = model.encode(x)
    for c in range(4):
        own = lists == c
        far = model.lookup_distances(x, c, codes[own])
        true = np.sqrt(vectors.squared(x, x[own]))
        assert (far <= true + error[own][None] + 1e-3).all()


def test_forest_keeps_parts():
    rng = random.Random(1)
    a, b = np.asarray([rng.randrange(60) for _ in range(40)]), np.asarray([rng.randrange(60) for _ in range(40)])
    nodes = set(a.tolist()) | set(b.tolist())
    edges = vectors._forest(a, b)
    assert classes(nodes, edges) == classes(nodes, list(zip(a.tolist(), b.tolist(), strict=True))) and len(edges) < len(nodes)


def test_lists_grow_with_the_root_of_the_rows():
    assert [vectors.lists_for(n) for n in (0, 100, 5120, 600_000, 4_000_000, 100_000_000, 10**10)] == [1, 1, 10, 1024, 2000, 10_000, 1 << 15]
