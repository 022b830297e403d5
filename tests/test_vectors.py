"""The stored vector index against a search of all rows."""

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from quarry.operators import chunks
from quarry.sources import vectors


def sample(n=1500):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(20)]
    return [(k, ["a", "007", "c d"][k % 3], [x + rng.gauss(0, 0.3) for x in centres[k % 20]]) for k in range(n)]


def test_recall_partitions_and_defined_cases(spark, tmp_path):
    odd = [(9000, "a", None), (9001, "a", []), (9002, "a", [0.0] * 12), (9003, "a", [float("nan")] * 12), (9004, "a", [1.0] * 3), (9005, "a", [None] * 12)]
    rows = spark.createDataFrame(sample() + odd, "vec_id long, module string, embedding array<float>")
    path = str(tmp_path / "index")
    vectors.build(rows, path, group="module")
    known = vectors.layout(spark, path)
    assert len(known.centroids) > 10 and known.probes < len(known.centroids)
    asked = rows.where("vec_id < 1500 and vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "module", F.col("embedding").alias("query"))
    found = {(r.query_id, r.vec_id) for r in vectors.search(spark, path, asked, k=10).collect()}
    exact = {(r.query_id, r.vec_id) for r in chunks.nearest(rows.where("vec_id < 1500"), asked, on="module", k=10).collect()}
    assert len(found) == len(exact) == 300 and len(found & exact) >= 0.9 * len(exact)
    every = {(r.query_id, r.vec_id) for r in vectors.search(spark, path, asked, k=10, probes=len(known.centroids)).collect()}
    assert every == exact and not any(v >= 9000 for _, v in every)
    assert vectors.search(spark, path, asked.limit(0)).count() == 0


def test_lists_that_are_not_probed_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame(sample(), "vec_id long, module string, embedding array<float>")
    path = str(tmp_path / "index")
    vectors.build(rows, path, group="module")
    part = vectors.lists_of(spark, path, ["c d"], [0, 1])
    with redirect_stdout(io.StringIO()) as out:
        part.explain("formatted")
    filters = out.getvalue().split("PartitionFilters")[1].split("\n")[0]
    assert "module" in filters and "list" in filters
    files = {r[0] for r in part.select(F.input_file_name()).distinct().collect()}
    assert files and all("module=c%20d" in f or "module=c d" in f for f in files) and all("list=0/" in f or "list=1/" in f for f in files)


def test_ties_go_to_the_lesser_key_and_blocks_agree(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(k, "a", [1.0, 0.0]) for k in range(40)] + [(100 + k, "a", [0.0, 1.0]) for k in range(3)], "vec_id long, module string, embedding array<float>")
    path = str(tmp_path / "index")
    vectors.build(rows, path, group="module", k=5)
    asked = spark.createDataFrame([(k, "a", [1.0, 0.1 * k]) for k in range(7)] + [(9, "none", [1.0, 0.0])], "query_id long, module string, query array<float>")
    plain = sorted(map(tuple, vectors.search(spark, path, asked, k=5, probes=99).collect()))
    assert [r[1] for r in plain if r[0] == 0] == [0, 1, 2, 3, 4] and not [r for r in plain if r[0] == 9]
    monkeypatch.setattr(vectors, "QUERIES", 3)
    assert sorted(map(tuple, vectors.search(spark, path, asked, k=5, probes=99).collect())) == plain
