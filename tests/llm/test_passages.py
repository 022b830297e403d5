import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import passages


@pytest.mark.parametrize("ties", [False, True])
def test_compact_windows_stand_for_each_subsequence_once(ties):
    rng = np.random.default_rng(1)
    for _ in range(10):
        h = rng.integers(0, 4 if ties else 10**9, 60)
        found = passages.compact_windows(h, 10)
        for i in range(60):
            for j in range(i + 9, 60):
                own = [(lo, c, hi) for lo, c, hi in found if lo <= i <= c <= j <= hi]
                assert len(own) == 1 and h[own[0][1]] == h[i : j + 1].min()
    assert len(passages.compact_windows(np.zeros(4000), 46)) < 400


def text_of(rng, vocab, n):
    return rng.choices(vocab, k=n)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    passage = [text_of(rng, vocab, n) for n in (55, 60, 80, 150, 400)]
    line = text_of(rng, vocab, 20)
    docs, truth = [], {}
    for k in range(60):
        words = text_of(rng, vocab, rng.randint(60, 300))
        if k % 3 == 0:
            p = list(passage[(k // 3) % 5])
            if k % 2:
                for _ in range(len(p) // 60):
                    p[rng.randrange(len(p))] = rng.choice(vocab)
            cut = rng.randrange(len(words))
            words = words[:cut] + p + words[cut:]
            truth.setdefault((k // 3) % 5, []).append(k)
        if rng.random() < 0.4:
            words += line
        docs.append((k, " ".join(words)))
    return docs, truth


def test_finds_repeated_passages_and_no_others(spark):
    docs, truth = corpus(3)
    docs += [(100, None), (101, ""), (102, "a b c"), (103, docs[1][1]), (None, docs[0][1]), (104, "again " * 300), (105, "again " * 200)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, value int")
    got = passages.find(df).collect()
    text = {k: (t or "").split() for k, t in docs if k is not None}
    linked = {(r.doc_id, r.other_doc_id) for r in got}
    for group in truth.values():
        for k in group[1:]:
            assert any(a == k and b in group for a, b in linked), (k, group)
    for r in got:
        assert r.doc_id > r.other_doc_id and r.end_word - r.start_word >= 50 and r.similarity >= 0.8
        x, y = text[r.doc_id][r.start_word : r.end_word], text[r.other_doc_id][r.other_start : r.other_end]
        sx, sy = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x, y))
        assert abs(len(sx & sy) / len(sx | sy) - r.similarity) < 1e-9
    dirty = {k for g in truth.values() for k in g} | {1, 103, 104, 105}
    assert {r.doc_id for r in got} | {r.other_doc_id for r in got} == dirty
    assert (103, 1) in linked and (105, 104) in linked


def test_empty_table(spark, no_documents):
    assert passages.find(no_documents).count() == 0


def test_finds_passages_beside_a_shared_line(spark):
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(50000)]
    docs, own = [], {}
    for g, (gap, n) in enumerate([(20, 1), (40, 1), (60, 1), (40, 2), (60, 2)] * 4):
        line, parts = text_of(rng, vocab, 20), [text_of(rng, vocab, 60) for _ in range(n)]
        for k in (2 * g, 2 * g + 1):
            words = list(line)
            for p in parts:
                words += text_of(rng, vocab, gap)
                own.setdefault(k, []).append((len(words), len(words) + 60))
                words += p
            docs.append((k, " ".join(words)))
    got = passages.find(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    spans = {k: [] for k in own}
    for r in got:
        assert (r.doc_id, r.other_doc_id) == (r.other_doc_id + 1, r.doc_id // 2 * 2) and r.similarity >= 0.8
        spans[r.doc_id].append((r.start_word, r.end_word))
    for k in range(1, len(docs), 2):
        for a, z in own[k]:
            assert any(p <= a and z <= q for p, q in spans[k]), (k, a, z, spans[k])


def test_similar_pieces_beside_a_line_and_in_another_order():
    rng = np.random.default_rng(2)
    line, p, q = (rng.integers(0, 2**60, n) for n in (16, 56, 70))
    x = np.concatenate([line, rng.integers(0, 2**60, 30), p, rng.integers(0, 2**60, 30), q])
    y = np.concatenate([q, rng.integers(0, 2**60, 50), line, rng.integers(0, 2**60, 50), p])
    assert passages.similar_pieces(x, y, 46, 0.8) == [(46, 101, 186, 241, 1.0), (132, 201, 0, 69, 1.0)]
    assert passages.trimmed(x, y, 46, 0.8) is None


def test_classes_of_groups_against_all_pairs(spark):
    """Groups of six and more near-equal passages: at least nine in ten of all linked pairs share a class, and strangers none."""
    rng = random.Random(21)
    vocab = [f"w{k}" for k in range(20000)]
    docs, group = [], {}
    for g in range(40):
        base = text_of(rng, vocab, 100 if g % 2 else 60)
        for _ in range(6 + g % 3):
            p = list(base)
            for at in rng.sample(range(len(p)), 1 if g % 2 else 0):
                p[at] = rng.choice(vocab)
            group[len(docs)] = g
            docs.append((len(docs), " ".join([*text_of(rng, vocab, rng.randint(30, 90)), *p, *text_of(rng, vocab, rng.randint(30, 90))])))
    got = passages.find(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    part = {r.doc_id: r.component_id for r in got} | {r.component_id: r.component_id for r in got}
    shingles = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in docs}
    linked = [(a, b) for a in group for b in group if a < b and group[a] == group[b] and len(shingles[a] & shingles[b]) >= 46]
    found = sum(part.get(a, a) == part.get(b, -1 - b) for a, b in linked)
    assert len(linked) > 600 and found >= 0.9 * len(linked), (found, len(linked))
    assert all(group[r.doc_id] == group[r.other_doc_id] for r in got)
    assert all(part[r.doc_id] == part[r.other_doc_id] <= r.other_doc_id < r.doc_id for r in got)


def plain_trim(x, y, least, similarity):
    """Drop the end with the widest gap until the stretches are similar, counting everything anew each time."""
    ix, iy = [k for k in range(len(x)) if x[k] in y], [k for k in range(len(y)) if y[k] in x]
    while ix and iy:
        a, b, c, d = ix[0], ix[-1], iy[0], iy[-1]
        if min(b - a, d - c) + 1 < least:
            return None
        sx, sy = set(x[a : b + 1]), set(y[c : d + 1])
        if len(sx & sy) / len(sx | sy) >= similarity:
            return a, b, c, d, len(sx & sy) / len(sx | sy)
        if len(ix) < 2 or len(iy) < 2:
            return None
        gap, end = max((ix[1] - a, 0), (b - ix[-2], 1), (iy[1] - c, 2), (d - iy[-2], 3))
        if gap <= 1:
            return None
        (ix if end < 2 else iy).pop(-(end % 2))
        if end < 2:
            iy = [k for k in iy if y[k] in {x[i] for i in ix}]
        else:
            ix = [k for k in ix if x[k] in {y[i] for i in iy}]
    return None


def test_trimming_step_by_step_equals_counting_anew():
    rng = np.random.default_rng(8)
    found = 0
    for _ in range(1500):
        v = int(rng.choice([4, 12, 40]))
        base = rng.integers(0, v, int(rng.integers(1, 40)))
        sides = []
        for _ in range(2):
            own = np.where(rng.random(len(base)) < 0.2, rng.integers(0, v * 3, len(base)), base)
            sides.append(np.concatenate([rng.integers(0, v * 4, int(rng.integers(0, 20))), own, rng.integers(0, v * 4, int(rng.integers(0, 20)))]))
        least, similarity = int(rng.integers(2, 12)), float(rng.choice([0.5, 0.8]))
        want = plain_trim(sides[0].tolist(), sides[1].tolist(), least, similarity)
        assert passages.trimmed(*sides, least, similarity) == want
        found += want is not None
    assert found > 100


def test_repeated_rows_of_equal_ids_link_with_others_alone(spark):
    rng = random.Random(12)
    shared, other = " ".join(text_of(rng, [f"w{k}" for k in range(500)], 80)), " ".join(text_of(rng, [f"v{k}" for k in range(500)], 80))
    df = spark.createDataFrame([(1, shared), (1, shared), (1, shared), (2, other), (2, other), (3, "x " + shared), (None, shared)], "doc_id bigint, text string")
    found = {(r.doc_id, r.other_doc_id, r.component_id) for r in passages.find(df).collect()}
    assert found == {(3, 1, 1)}


@pytest.mark.parametrize("n_line", [30, 40])
def test_finds_passages_that_begin_with_a_frequent_line(spark, monkeypatch, n_line):
    """25 pairs of documents share 60 words, the first of which are a line of 200 other documents."""
    monkeypatch.setattr(passages, "DIRECT", 8, raising=False)
    rng = random.Random(n_line)
    vocab = [f"w{k}" for k in range(50000)]
    line, docs = text_of(rng, vocab, n_line), []
    for k in range(200):
        docs.append((k, " ".join([*text_of(rng, vocab, 60), *line, *text_of(rng, vocab, 60)])))
    for k in range(25):
        own = text_of(rng, vocab, 60 - n_line)
        for _ in range(2):
            docs.append((len(docs), " ".join([*text_of(rng, vocab, 60), *line, *own, *text_of(rng, vocab, 60)])))
    got = passages.find(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.other_doc_id, r.component_id) for r in got} == {(201 + 2 * k, 200 + 2 * k, 200 + 2 * k) for k in range(25)}
    assert all(60 <= r.start_word < r.end_word <= 120 and r.similarity == 1 for r in got)


def test_windows_meet_as_all_pairs_of_classes_do(spark, monkeypatch):
    """What the tokens of a frequent value leave of its pairs holds every pair with a similar passage, repeated tokens or not."""
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(30000)]
    line, again = text_of(rng, vocab, 35), text_of(rng, vocab, 9)
    docs = []
    for k in range(90):
        own = text_of(rng, vocab, 70) if k % 3 else list(docs[k - 1][1].split()[-70:] if k else text_of(rng, vocab, 70))
        for at in rng.sample(range(70), k % 4):
            own[at] = rng.choice(vocab)
        docs.append((k, " ".join([*text_of(rng, vocab, 30), *(again * 8 if k % 5 == 0 else []), *line, *own])))
    df, found = spark.createDataFrame(docs, "doc_id bigint, text string"), {}
    for most in (1, 10**6):
        monkeypatch.setattr(passages, "DIRECT", most)
        found[most] = {tuple(r) for r in passages.find(df).collect()}
    assert found[1] == found[10**6] and len({r[0] for r in found[1]}) >= 25


def test_pairs_met_by_few_functions_are_left_out_of_the_interval_join():
    """Each pair gives what joint_passages makes of its rows, and in whatever batches the rows come."""
    rng, rows, want = np.random.default_rng(6), [], []
    for pair in range(200):
        found = []
        for f in rng.choice(6, int(rng.integers(1, 7)), replace=False).tolist():
            c = int(rng.integers(50, 60))
            found.append((0, f, c - int(rng.integers(20, 50)), c, c + int(rng.integers(20, 50)), c - int(rng.integers(20, 50)), c, c + int(rng.integers(20, 50))))
        rows += [(pair, pair // 3, *w[1:]) for w in found]
        want += [(pair, pair // 3, *p) for p in passages.joint_passages(found, 3, 46)]
    names = ["id", "other", "f", "l", "c", "r", "ol", "oc", "or"]
    t = pa.table({k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*rows, strict=True), strict=True)})
    assert len(want) > 20
    for most in (1, 7, 10**6):
        got = [tuple(r.values()) for b in passages._join_intervals(3, 46)(iter(t.to_batches(most))) for r in b.to_pylist()]
        assert got == want


def test_windows_are_shuffled_once_for_their_leaders(spark, monkeypatch):
    """What several documents hold and the leaders of each value come from one exchange, and the rows that met are not stored."""
    plans, label_of = {}, passages.table

    def table(df, label):
        plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return label_of(df, label)

    monkeypatch.setattr(passages, "table", table)
    docs, _ = corpus(3)
    assert passages.find(spark.createDataFrame(docs, "doc_id bigint, text string")).count()
    assert "met" not in plans and "Join" not in plans["shared"].split("mapInArrow")[0].split("MapInArrow")[0]


def plain_windows(h, least):
    """One node after the other from the root; of equal hashes the middle one."""
    out, stack = [], [(0, len(h) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo + 1 >= least:
            c = min((k for k in range(lo, hi + 1) if h[k] == min(h[lo : hi + 1])), key=lambda k: abs(k - (lo + hi) / 2))
            out.append((lo, c, hi))
            stack += [(lo, c - 1), (c + 1, hi)]
    return sorted(out)


def test_windows_of_many_texts_equal_those_node_by_node():
    rng = np.random.default_rng(9)
    for _ in range(60):
        least, offsets = int(rng.choice([1, 2, 7, 20])), np.append(0, np.cumsum(rng.integers(0, 60, 5)))
        value = rng.integers(0, int(rng.choice([2, 20, 2**60])), offsets[-1]).astype(np.uint64)
        text, spans = passages.windows_of_texts(value, offsets, least, passages._repeats(value, offsets))
        for k, (a, z) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            assert sorted(map(tuple, (spans[text == k] - a).tolist())) == plain_windows(value[a:z].tolist(), least)


def test_only_pairs_without_a_similar_piece_are_left_unlooked_at():
    rng, found, left = np.random.default_rng(7), 0, 0
    for _ in range(300):
        v, sides, offsets = int(rng.choice([8, 40, 2**60])), ([], []), ([0], [0])
        for _ in range(4):
            base = rng.integers(0, v, int(rng.integers(0, 120)))
            for s in (0, 1):
                own = np.where(rng.random(len(base)) < rng.random() / 5, rng.integers(0, v, len(base)), base)
                sides[s].append(np.concatenate([rng.integers(0, v, int(rng.integers(0, 30))), own]))
                offsets[s].append(offsets[s][-1] + len(sides[s][-1]))
        (x, y), (xo, yo) = (np.concatenate(t) for t in sides), (np.array(o) for o in offsets)
        may, _ = passages.may_be_similar(x, xo, y, yo, 20, 0.8)
        for k in range(4):
            pieces = passages.similar_pieces(sides[0][k], sides[1][k], 20, 0.8, 0)
            assert may[k] or not pieces
            found, left = found + bool(pieces), left + (not may[k])
    assert found > 100 and left > 100


def test_windows_that_few_functions_support_do_not_meet(spark, monkeypatch):
    """60 documents with a line of 16 words, of which pairs share a passage: hardly a pair meets by fewer functions than a passage needs."""
    met, label_of = [], passages.table

    def table(df, label):
        out = label_of(df, label)
        if label == "unmet":
            met.extend(out.select("id", "other", "f").distinct().groupBy("id", "other").count().collect())
        return out

    monkeypatch.setattr(passages, "table", table)
    rng = random.Random(15)
    vocab = [f"w{k}" for k in range(50000)]
    line, docs = text_of(rng, vocab, 16), []
    for k in range(50):
        own = text_of(rng, vocab, 60)
        for _ in range(2 if k % 5 == 0 else 1):
            docs.append((len(docs), " ".join([*text_of(rng, vocab, 60), *line, *own, *text_of(rng, vocab, 30)])))
    got = passages.find(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    pairs = {(b[0], a[0]) for a, b in zip(docs, docs[1:]) if a[1].split()[76:136] == b[1].split()[76:136]}
    assert {(r.doc_id, r.other_doc_id) for r in got} == pairs and len(pairs) == 10
    assert sum(r[2] < 3 for r in met) < 300  # 1529 where any two windows of equal value met


def test_copies_alone_have_their_words_counted(spark):
    """A filter on the number of words would be moved to before the join and match a pattern in every text."""
    docs, _ = corpus(3)
    out = passages.find(spark.createDataFrame([*docs, (100, docs[1][1])], "doc_id bigint, text string"))
    assert out.where("similarity = 1 and doc_id = 100").count() == 1
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
