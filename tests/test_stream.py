"""The file stream's refresh, and the guard of the registry."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quarry.sources import snapshots
from quarry.streaming.incremental import refresh_stream


def test_stream_replaces_changed_files(spark, tmp_path):
    incoming, target = str(tmp_path / "in"), str(tmp_path / "out")

    def send(k, rows):
        spark.createDataFrame(rows, "path string, language string, text string").coalesce(1).write.parquet(f"{incoming}/{k}")
        refresh_stream(spark, f"{incoming}/*", target, str(tmp_path / "cp")).awaitTermination()

    send(1, [("a.py", "python", "def f():\n    pass\n"), ("b.py", "python", "def g():\n    pass\n")])
    send(2, [("a.py", "python", "def h():\n    pass\n")])
    got = {r.path: [f.name for f in r.functions] for r in snapshots.read(spark, target).collect()}
    assert got == {"a.py": ["h"], "b.py": ["g"]}


def test_stream_takes_the_newest_file_and_refuses_gaps(spark, tmp_path):
    incoming, target = tmp_path / "in", tmp_path / "out"
    for k, (folder, body) in enumerate([("b", "def old():\n    pass\n"), ("a", "def new():\n    pass\n")]):
        spark.createDataFrame([("a.py", "python", body)], "path string, language string, text string").coalesce(1).write.parquet(str(incoming / folder))
        for file in (incoming / folder).glob("*.parquet"):
            os.utime(file, (1_000_000 + k, 1_000_000 + k))
    run = lambda: refresh_stream(spark, f"{incoming}/*", str(target), str(tmp_path / "cp")).awaitTermination()
    run()
    assert [f.name for r in snapshots.read(spark, str(target)).collect() for f in r.functions] == ["new"]
    for k in range(4):
        spark.createDataFrame([(f"{k}.py", "python", "x = 1\n")], "path string, language string, text string").write.parquet(str(incoming / f"more{k}"))
        run()
    assert snapshots.read(spark, str(target)).count() == 5 and snapshots.versions(spark, str(target)) == [2, 3, 4]
    assert {r.path for r in snapshots.read(spark, str(target), 3).collect()} == {"a.py", "0.py", "1.py", "2.py"}
    (target / "pointer-4.json").unlink()
    spark.createDataFrame([("z.py", "python", "")], "path string, language string, text string").write.parquet(str(incoming / "last"))
    with pytest.raises(Exception, match="missing"):
        run()


@pytest.mark.parametrize("left", [["corpus_pipeline.py"], []])
def test_registry_without_the_training_data_part(tmp_path, left):
    """The other queries stay when the folder is missing, with and without the pipeline's file, and where the original can be imported too."""
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'g4_pagerank' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    for name in ("quarry", "__spark_entry__.py", *left):
        if (root / name).exists():
            subprocess.run(["cp", "-r", str(root / name), str(tmp_path)], check=True)
    shutil.rmtree(tmp_path / "quarry/llm", ignore_errors=True)
    for path in (str(tmp_path), f"{tmp_path}:{root}"):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": path}, check=True, timeout=120)
