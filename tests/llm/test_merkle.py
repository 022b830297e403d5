import hashlib
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SCHEMA, SF

from quarry.llm import merkle, queries

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def climb(tree, k):
    """(left, right) beside a node, level by level."""
    steps = []
    for nodes in tree[:-1]:
        lo = k // 16 * 16
        steps.append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + 16])))
        k //= 16
    return steps


def brute(rows):
    leaf = lambda r, text: H(*(field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"], leaf(r, r["text"]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for s in order}
    inner = {s: levels([x[1] for x in trees[s]]) for s in order}
    outer = levels([inner[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for k, (doc_id, own, r) in enumerate(trees[s]):
            steps = climb(inner[s], k) + climb(outer, n)
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            h = leaf(r, lower(r["text"])) if changed else own
            for a, b in steps:
                h = H(a, h, b)
            out.append((doc_id, own, inner[s][-1][0], outer[-1][0], H(*(a + b for a, b in steps)), h, h == outer[-1][0]))
    return sorted(out, key=repr)


def rows_of(found):
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_sources_of_many_sizes(spark):
    sizes = {None: 3, "": 1, "one": 1, "b": 16, "é": 17, "Z": 256, "hot": 1200, "c": 257, **{f"s{k}": 1 for k in range(20)}}
    rows = [{"doc_id": 10_000 * n + 7 * k, "source": s, "lang": None if k % 5 == 0 else "en", "n_chars": k, "text": None if k % 11 == 0 else "Abc É\n" * (k % 4)} for n, (s, size) in enumerate(sizes.items()) for k in range(size)]
    rows += [dict(rows[40]), {**rows[40], "text": "other"}, {"doc_id": None, "source": "b", "lang": "en", "n_chars": None, "text": "X"}]
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA).repartition(7)
    got = rows_of(merkle.manifest(df.withColumn("tree", F.lit(1)).withColumn("hash", F.lit("x")), merkle.lowered()))
    assert got == brute(rows)
    plain = merkle.manifest(df)
    assert plain.where("not verified").count() == 0 and {r.root for r in plain.select("root").distinct().collect()} == {got[0][3]}


def test_the_query_on_the_given_table(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(queries.op12_merkle(spark, SF))
    assert got == brute(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single_tables(spark, no_documents, documents, n):
    df = documents.limit(n) if n else no_documents
    found = merkle.manifest(df, merkle.lowered()).collect()
    assert len(found) == n and all(r.leaf == r.subroot == r.root and r.proof_sha256 == H() for r in found)


@pytest.mark.parametrize("cuts", [[], [1], [15, 16, 17], [5, 270, 300], [256], [300, 512, 513]])
def test_a_range_merges_across_any_cuts(cuts):
    leaves = [H(str(k)) for k in range(600)]
    whole = levels(leaves)
    runs, loose = {}, {}
    for lo, hi in zip([0, *cuts], [*cuts, 600], strict=True):
        parts = [pa.record_batch({"tree": pa.array(["t"] * (b - a)), "pos": pa.array(range(a, b), pa.int64()), "hash": pa.array(leaves[a:b])}) for a, b in [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]]
        for batch in merkle.mountain_range(iter(parts)):
            for r in batch.to_pylist():
                if r["children"] is None:
                    assert loose.setdefault((r["level"], r["run"]), r["hash"]) == whole[r["level"]][r["run"]]
                else:
                    runs[r["level"], r["run"]] = r["hash"]
                    assert r["hash"] == whole[r["level"] + 1][r["run"]] == H(*r["children"])
    assert len(loose) <= 30 * 3 * (len(cuts) + 1)
    for level in range(3):
        for number, value in enumerate(whole[level]):
            assert (level, number // 16) in runs or (level, number) in loose or (level - 1, number) not in runs, value
