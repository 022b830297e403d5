import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import SF

from quarry.llm import negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, anchor, positives=5, best=10):
    """rows (id, vector, label) as the operator takes them."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    held = [(k, i, [math.floor(256 * x) for x in v], lab) for k, (i, v, lab) in enumerate(rows) if lab is not None and fine(v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for k, i, v, lab in held:
        if i is None or not anchor(i):
            continue
        near = sorted(((-score(v, w), math.inf if j is None else j, n, other, j) for n, j, w, other in held if n != k and len(w) == len(v)))
        for p in [x for x in near if x[3] == lab][:positives]:
            fits = [x for x in near if x[3] != lab and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]][:best]
            out += [(i, p[4], r + 1, x[4], -p[0], -x[0]) for r, x in enumerate(fits)]
    return sorted(out, key=repr)


def got(found):
    return sorted((tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def test_the_query_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 and r.label is not None else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(queries.op13_hard_negatives(spark, SF)) == brute(rows, lambda i: i % 100 == 0)


def test_clusters_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 32)  # many cells and blocks
    monkeypatch.setattr(negatives, "QUERIES", 8)
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    near = lambda c: [x + rng.gauss(0, 0.15) for x in c]
    rows = [(k, near(centres[k % 12]), k % 3) for k in range(900)]
    hot = near(centres[0])
    rows += [(1000 + k, hot, k % 2) for k in range(300)]  # copies under two labels
    rows += [(2000, None, 1), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2020, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (2030, [float("inf")] * 6, 1), (2040, hot, None), (2050, [0.0] * 6, 1), (2060, [0.5, 0.5], 1), (2070, [0.5, 0.25], 2), (2080, [], 1), (2090, [], 2), (None, hot, 2), (2100, hot, 1), (2100, hot, 1), (2110, [-x for x in hot], 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = negatives.mine(df.withColumn("fid", F.lit(1)).withColumn("score", F.lit("x")), anchors=F.col("vec_id") % 10 == 0)
    assert got(found) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()], lambda i: i % 10 == 0)


@pytest.mark.parametrize("rows", [[], [(100, [1.0, 0.0], 1)], [(100, [1.0, 0.0], 1), (200, [0.5, 0.0], 1)], [(7, [1.0], 1), (8, [1.0], 1)]])
def test_too_few_rows_give_none(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(negatives.mine(df, anchors=F.col("vec_id") % 100 == 0)) == []


def test_blocks_hold_every_row_sorted_by_pivot_and_distance(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    rng = random.Random(3)
    rows = [(k, [math.cos(k % 16) + rng.gauss(0, 0.001), math.sin(k % 16) + rng.gauss(0, 0.001), k % 16 / 8], k % 2) for k in range(3200)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = df.select(F.col("vec_id").alias("fid"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), negatives.whole(F.col("embedding")).alias("vector"), F.size("embedding").alias("dim"))
    keys = negatives.fitted(kept, 1000)
    index = negatives.stored(kept, keys)
    assert index.select(F.sum(F.size("ids"))).head()[0] == 3200 and index.select(F.max(F.size("ids"))).head()[0] <= 64
    spread = 0
    for r in index.collect():
        key = keys[r["dim"]]
        x = negatives.lifted(np.frombuffer(r["vectors"], "<f8").reshape(-1, 3), key.most)
        far = np.sqrt(((x[:, None] - key.pivots[None]) ** 2).sum(2))
        assert (far.argmin(1) == r["pivot"]).all() and (np.floor(far.min(1) / key.width) == r["cell"]).all()
        assert (np.diff(far[:, r["pivot"]]) >= -1e-9).all() and key.first[r["pivot"]] <= r["cell"] <= key.last[r["pivot"]]
        spread += 1
    assert spread > 40 and len(keys[3].pivots) > 1
