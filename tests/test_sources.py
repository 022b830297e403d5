"""Folders read with pushed filters and written a file a row; tables in slots."""

import io
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, LessThanOrEqual, Not, StringEndsWith, StringStartsWith

from quarry.sources import folders, repo, snapshots


def tree(root: Path):
    found = {}
    for k in range(40):
        name = f"{'abc'[k % 3]}/{'deep/' * (k % 4)}{'_' * (k % 2)}f{k}.{['py', 'md', 'min.js'][k % 3]}"
        found[name] = "x" * (k * 10)
    found |= {".hidden/x.py": "h", "top.py": "t", "node_modules/skipped.py": "n"}
    for name, body in found.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return found


class Counting:
    """A file system that notes what is opened and listed."""

    def __init__(self, inner):
        self.inner, self.opened, self.listed = inner, [], 0

    def open_input_stream(self, path):
        self.opened.append(path)
        return self.inner.open_input_stream(path)

    def get_file_info(self, what):
        self.listed += 1
        return self.inner.get_file_info(what)


def test_files_that_a_filter_leaves_out_are_not_opened(tmp_path, monkeypatch):
    found = tree(tmp_path)
    system = Counting(folders.file_system(str(tmp_path))[0])
    monkeypatch.setattr(folders, "file_system", lambda root: (system, str(tmp_path)))
    reader = folders.RepositoryFiles({"path": str(tmp_path), "prune": "node_modules", "push": "true"}).reader(None)
    kept = EqualTo(("content",), b"x")
    asked = [StringEndsWith(("path",), ".py"), LessThanOrEqual(("size_bytes",), 200), Not(StringStartsWith(("path",), "a/")), Not(In(("path",), ("top.py",))), kept]
    assert list(reader.pushFilters(asked)) == [kept]
    got = {path: size for part in reader.partitions() for path, size, _ in reader.read(part)}
    want = {p for p, body in found.items() if p.endswith(".py") and len(body) <= 200 and not p.startswith("a/") and p != "top.py" and "node_modules" not in p}
    assert set(got) == want and len(system.opened) == len(want)


@pytest.mark.parametrize("listings", [1, 3, 64])
def test_every_file_is_in_one_listing(tmp_path, listings):
    found = tree(tmp_path)
    reader = folders.RepositoryFiles({"path": str(tmp_path), "listings": str(listings)}).reader(None)
    parts = reader.partitions()
    got = [path for part in parts for path, _, _ in reader.read(part)]
    assert sorted(got) == sorted(found) and all(not hasattr(p, "files") for p in parts)


def test_the_plan_shows_what_is_pushed(spark, tmp_path):
    found = tree(tmp_path)
    before = spark.conf.get(folders.PUSHDOWN)
    spark.conf.set(folders.PUSHDOWN, "true")
    try:
        spark.dataSource.register(folders.RepositoryFiles)
        rows = spark.read.format("repository_files").option("path", str(tmp_path)).option("push", "true").load().where(F.col("path").endswith(".py") & (F.col("size_bytes") <= 100))
        with redirect_stdout(io.StringIO()) as out:
            rows.explain("formatted")
        assert "PushedFilters" in out.getvalue() and "size_bytes" in out.getvalue().split("PushedFilters")[1].split("\n")[0]
        want = {p for p, body in found.items() if p.endswith(".py") and len(body) <= 100}
        assert {r.path for r in rows.collect()} == want
        pushed = {r.path for r in repo.files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(folders.PUSHDOWN, before)
    assert pushed == {r.path for r in repo.files(spark, str(tmp_path)).collect()} and "top.py" in pushed


def test_documents_are_written_by_tasks_and_an_aborted_job_leaves_nothing(spark, tmp_path):
    target = tmp_path / "context"
    docs = spark.createDataFrame([(f"Doc {k}", f"text é {k}") for k in range(30)] + [("empty", "  "), ("none", None)], "name string, text string").repartition(5)
    repo.write_documents(docs, str(target))
    assert sorted(p.name for p in target.iterdir()) == sorted(f"doc-{k}.md" for k in range(30)) and (target / "doc-7.md").read_text() == "text é 7"
    assert {(r.name, r.text) for r in repo.documents(spark, str(target)).collect()} == {(f"doc-{k}.md", f"text é {k}") for k in range(30)}
    bad = spark.createDataFrame([(f"doc-{k}", "new") for k in range(20)] + [("../out", "new")], "name string, text string").repartition(4)
    with pytest.raises(Exception, match="not a file name"):
        repo.write_documents(bad, str(target), slug=False)
    assert sorted(p.name for p in target.iterdir()) == sorted(f"doc-{k}.md" for k in range(30)) and (target / "doc-7.md").read_text() == "text é 7"
    repo.write_documents(bad.where("name <> '../out'"), str(target), slug=False)
    assert (target / "doc-7.md").read_text() == "new" and (target / "doc-25.md").read_text() == "text é 25"


def test_a_change_rewrites_its_slots_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(500).selectExpr("concat('p', id) as path", "id as v", "array(struct(id as x, 'a' as y)) as more")
    snapshots.write(rows, path, "path", slots=16)
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    changed = rows.withColumn("v", F.when(F.col("path") == "p7", -1).otherwise(F.col("v")))
    assert len(snapshots.replace(changed, path, "path")) == 1
    after = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert all(after[p] == t for p, t in before.items()) and len({p.parent for p in after if p not in before}) == 1
    assert {r.path: r.v for r in snapshots.read(spark, path).collect()} == {f"p{k}": -1 if k == 7 else k for k in range(500)}
    assert snapshots.read(spark, path, 0).where("v = -1").count() == 0
    assert snapshots.replace(changed, path, "path") == [] and snapshots.versions(spark, path) == [0, 1]
    new = spark.createDataFrame([("p9", 90), ("q", 1)], "path string, v long").withColumn("more", F.expr("cast(null as array<struct<x:bigint,y:string>>)"))
    gone = spark.createDataFrame([("p3",), ("nowhere",)], "path string")
    snapshots.upsert(spark, path, new, gone=gone)
    got = {r.path: r.v for r in snapshots.read(spark, path).collect()}
    assert got["p9"] == 90 and got["q"] == 1 and "p3" not in got and len(got) == 500
    snapshots.replace(changed.limit(0), path, "path")
    assert snapshots.read(spark, path).count() == 0 and snapshots.read(spark, path).columns == ["path", "v", "more"]
    for k in range(4):
        snapshots.write(rows.limit(k + 1), path, "path")
    assert len(snapshots.versions(spark, path)) == snapshots.KEEP + 1 and snapshots.read(spark, path).count() == 4
    named = {p.name for p in Path(path).iterdir() if p.name.startswith("v")}
    assert len(named) == snapshots.KEEP + 1
    assert snapshots.read(spark, str(tmp_path / "none")) is None


def test_a_failed_change_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(50).selectExpr("concat('p', id) as path", "id as v")
    snapshots.write(rows, path, "path", slots=4)
    with pytest.raises(Exception, match="stop"):
        snapshots.upsert(spark, path, rows.withColumn("v", F.when(F.col("v") == 30, F.raise_error(F.lit("stop"))).otherwise(F.col("v") + 1).cast("long")))
    assert snapshots.versions(spark, path) == [0] and snapshots.read(spark, path).agg(F.sum("v")).head()[0] == 1225
