"""Table operators on small tables, and the commands end to end."""

import subprocess

import pytest
from pyspark.sql import functions as F

from quarry import pipeline
from quarry.functions import classify, scores
from quarry.operators import documents, evaluate, extract, graph, providers, refresh, resolve
from quarry.sources import repo, scratch


def test_pagerank_sums_to_one_and_prefers_the_cited(spark):
    nodes = spark.createDataFrame([(c, k) for k, c in enumerate("abcd")], "id string, ord long")
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "a")], "src string, dst string")
    rank = {r.id: r.pagerank for r in graph.pagerank(nodes, edges).collect()}
    assert sum(rank.values()) == pytest.approx(1) and max(rank, key=rank.get) == "c"


def test_edges_and_routes_of_equal_keys(spark):
    nodes = spark.createDataFrame([("a", "file", 1), ("b", "file", 2), ("r", "route", 3), ("r", "route", 4), ("a", "file", 5)], "id string, kind string, ord long")
    assert {(r.id, r.ord) for r in graph.merge_nodes(nodes).collect()} == {("a", 5), ("b", 2), ("r", 3)}
    edges = spark.createDataFrame([("a", "b", "IMPORTS"), ("a", "b", "CONTAINS"), ("a", "b", "CALLS"), ("a", "zz", "CALLS"), ("a", "yy", "CONTAINS")], "src string, dst string, relation string")
    assert {tuple(r) for r in graph.merge_edges(edges, nodes).collect()} == {("a", "b", "CONTAINS"), ("a", "yy", "CONTAINS")}


@pytest.mark.parametrize(("changed", "total", "broken", "want"), [(0, 2, 0, "none"), (3, 4, 0, "full"), (1, 4, 0, "partial"), (2, 4, 0, "partial"), (0, 2, 1, "docs_only")])
def test_decision(spark, changed, total, broken, want):
    old = spark.createDataFrame([(str(k), "h") for k in range(total)], "path string, hash string")
    now = spark.createDataFrame([(str(k), "x" if k < changed else "h") for k in range(total)], "path string, hash string")
    row = refresh.decision(refresh.diff(now, old), spark.range(broken)).head()
    assert row.decision == want and row.n_stale == changed


def test_relative_imports_resolve_loosely(spark):
    files = spark.createDataFrame([("src/a/models.py",), ("src/b.py",), ("src/pkg/__init__.py",)], "path string")
    rows = [(1, "src/a/x.py", "python", ".models", ["M"]), (2, "src/a/x.py", "python", "b", []), (3, "x.py", "python", "os.path", []), (4, "x.py", "python", "nope", []), (5, "x.rs", "rust", "b", []), (6, "x.py", "python", "pkg", [])]
    imports = spark.createDataFrame(rows, "imp long, file string, language string, module string, names array<string>")
    got = {r.imp: (r.target, r.resolution) for r in resolve.resolve_imports(imports, files, bases=["src", ""]).collect()}
    assert got == {1: ("src/a/models.py", "fuzzy"), 2: ("src/b.py", "exact"), 3: ("os.path", "external"), 4: ("nope", "unresolved"), 5: ("b", "unresolved"), 6: ("src/pkg/__init__.py", "exact")}


PYTHON = '''"""Doc."""
import os
from .models import User
LIMIT = 3
class Service(Base):
    """Does things."""
    name = 1
    def run(self, x: int) -> "User":
        return self._go()
    def _go(self):
        return 1
@app.get("/health")
async def health(request):
    return os.environ["API_KEY"]
'''
GO = 'package main\nimport (\n\t"fmt"\n)\nconst Limit = 3\ntype Server struct {\n\tname string\n}\nfunc (s *Server) Start() error {\n\treturn nil\n}\nfunc main() {\n\thttp.HandleFunc("/h", handle)\n}\n'


def test_extraction(spark):
    files = spark.createDataFrame([("a.py", "python", PYTHON), ("m.go", "go", GO), ("bad.py", "python", "def ("), ("x.txt", None, "TODO x")], "path string, language string, text string")
    got = {r.path: r for r in extract.extractions(files).collect()}
    a, m = got["a.py"], got["m.go"]
    assert [f.name for f in a.functions] == ["health"] and a.functions[0].is_async
    assert [x.name for x in a.classes[0].methods] == ["run", "_go"] and a.classes[0].methods[0].return_type == "'User'"
    assert [(i.module, i.is_relative) for i in a.imports] == [("os", False), (".models", True)]
    assert a.constants[0].name == "LIMIT" and a.db_models[0].fields == ["name"] and a.env_vars == ["API_KEY"]
    assert (a.route_handlers[0].path, a.route_handlers[0].method) == ("/health", "GET") and a.has_module_docstring
    assert [f.name for f in m.functions] == ["Start", "main"] and [x.name for x in m.classes[0].methods] == ["Start"]
    assert {e.name for e in m.exports} >= {"Server", "Limit"} and m.route_handlers[0].handler_function == "handle"
    assert got["bad.py"].error.startswith("SyntaxError") and got["x.txt"].signal_lines[0].category == "todo"


def vectors(texts):
    return [[float(len(t) % 7), 1.0] for t in texts]


def test_commands_end_to_end(spark, tmp_path):
    root, out = tmp_path / "repo", str(tmp_path / "out")
    sources = {
        "src/app.py": PYTHON,
        "src/models.py": "class Base:\n    def run(self):\n        pass\n\nclass User(Base):\n    pass\n",
        "src/util.py": "from models import User, Base\n# HACK order matters\nclass Job(Base):\n    def run(self):\n        pass\ndef go() -> User:\n    return User()\n",
        "web/a.ts": 'import { b } from "@/b";\nexport const a = () => b();\n',
        "web/lib/b.ts": "export function b() {}\n",
        "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./web/lib/*"]}}}',
        "go.mod": "module example.com/m\n",
        "cmd/main.go": 'package main\nimport "example.com/m/store"\nfunc main() {}\n',
        "store/store.go": "package store\nfunc Open() {}\n",
        "src/pkg/__init__.py": "VERSION = 1\n",
        ".gitignore": "secret/\n",
        "secret/x.py": "x = 1\n",
        "node_modules/x.py": "x = 1\n",
        "README.md": "# r\n",
    }
    for name, body in sources.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    p = pipeline.parse(spark, str(root), out, embed=vectors)
    assert {r.path for r in p.files.collect()} == set(sources) - {"secret/x.py", "node_modules/x.py"}  # names that begin with a dot or an underscore too
    edges = {tuple(r) for r in p.edges.select("src", "dst", "relation").collect()}
    assert {("file::src/util.py", "file::src/models.py", "IMPORTS"), ("file::web/a.ts", "file::web/lib/b.ts", "IMPORTS")} <= edges
    assert ("func::src/util.py::Job.run", "func::src/models.py::Base.run", "CALLS") in edges
    assert p.nodes.agg(F.sum("pagerank")).head()[0] == pytest.approx(1)
    stored = {r.chunk_id: r for r in repo.load(spark, f"{out}/chunks").collect()}
    assert {"function::src/util.py::go", "function::src/util.py::Job.run", "class::src/models.py::User", "file_summary::web/a.ts::web/a.ts"} <= set(stored)
    assert all(r.embedding is not None and r.n_tokens > 0 for r in stored.values()) and "# Class: Job" in stored["function::src/util.py::Job.run"].text
    assert 0 <= spark.read.parquet(f"{out}/resolution_rate").head().rate <= 1
    report = pipeline.generate(spark, out, embed=vectors).collect()
    assert {"dependency-index", "conventions"} <= {r.document for r in report}
    asked = {r.name: r.prompt for r in spark.read.parquet(f"{out}/prompts").collect()}
    assert any("# Class: Job" in t and "HACK order matters" in t for t in asked.values())
    scored, gaps = pipeline.assess(spark, out, root=str(root), judge=lambda text: 0.25)
    assert scored.count() == len(report) and {r.usefulness for r in scored.collect()} == {0.25} and "module" in gaps.columns
    assert pipeline.update(spark, str(root), out).head()["n_stale"] == 0
    (root / "src/util.py").write_text("def other():\n    pass\n")
    context = next(f for f in (tmp_path / "out/context").glob("*.md") if f.stem not in ("AGENTS", "CONVENTIONS", "OVERVIEW", "dependency-index"))
    context.write_text("see `old/place/b.ts` and `no/such.py`\n")
    row = pipeline.update(spark, str(root), out, embed=vectors).head()
    assert (row.n_stale, row.n_new, row.decision) == (1, 0, "partial")
    assert context.read_text() == "see `web/lib/b.ts` and \n"
    assert [r.ratio for r in spark.read.parquet(f"{out}/stale_modules").collect()] != []
    names = {f.name for r in repo.load(spark, f"{out}/extractions").collect() for f in r.functions}
    assert "other" in names and "go" not in names
    after = {r.chunk_id: r for r in repo.load(spark, f"{out}/chunks").collect()}
    assert "function::src/util.py::go" not in after and after["function::src/util.py::other"].embedding is not None


def test_git_history_and_urls(spark, tmp_path):
    git = ["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.co"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for k in range(3):
        (tmp_path / "a.py").write_text(f"x = {k}\n")
        (tmp_path / f"b{k}.py").write_text("y = 1\n")
        subprocess.run([*git, "add", "-A"], check=True)
        subprocess.run([*git, "commit", "-qm", f"c{k}"], check=True)
    spark.dataSource.register(repo.GitLog)
    log = spark.read.format("git_log").option("path", str(tmp_path)).load()
    assert {r.path: r.changes for r in repo.churn(log).collect()} == {"a.py": 3, "b0.py": 1, "b1.py": 1, "b2.py": 1}
    assert {r.path: r.changes for r in repo.churn(log, 2).collect()} == {"a.py": 2, "b1.py": 1, "b2.py": 1}
    head = repo.head_commit(str(tmp_path))
    assert repo.commit_distance(str(tmp_path), f"{head}~2") == 2 and repo.commit_distance(str(tmp_path), "nope") is None
    copy = repo.checkout(str(tmp_path), str(tmp_path / "copy"))
    assert repo.head_commit(copy) == head and repo.checkout(str(tmp_path), copy) == copy


def test_providers():
    makers = {"anthropic": lambda key: lambda text: f"{key}:{text}"}
    assert providers.chosen(environment={}) is None and providers.client(makers, environment={}) is None
    assert providers.chosen(environment={"ANTHROPIC_API_KEY": "a", "OPENROUTER_API_KEY": "b"}) == "openrouter"
    assert providers.client(makers, environment={"ANTHROPIC_API_KEY": "a"})("x") == "a:x"
    with pytest.raises(RuntimeError):
        providers.client(makers, environment={"OPENROUTER_API_KEY": "b"})


def test_judge_falls_back(spark):
    docs = spark.createDataFrame([("a", "good because it never fails"), ("b", "bad"), ("c", None)], "name string, text string")

    def judge(text):
        if text == "bad":
            raise OSError
        return 7.0

    got = {r.name: r.s for r in docs.select("name", scores.judged_usefulness(F.col("text"), judge).alias("s")).collect()}
    plain = {r.name: r.s for r in docs.select("name", scores.usefulness(F.col("text")).alias("s")).collect()}
    assert got == {"a": 1.0, "b": plain["b"], "c": plain["c"]}


def test_mentions_equal_contains(spark):
    texts = ["see src/util.py and README", "two words here\nthe  United\tStates", "data.py; xUnited Kingdomx", ""]
    subjects = ["util.py", "til", "words", "two words", "words here", "here\nthe", "United States", "United Kingdom", "a.py", "absent", "README", "x", ""]
    got = {r.subject for r in evaluate.mentioned(spark.createDataFrame([(s,) for s in subjects], "subject string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {s for s in subjects if s and any(s in t for t in texts)}
    assert evaluate.mentioned(spark.createDataFrame([], "subject string"), spark.createDataFrame([("a",)], "text string")).count() == 0


def test_numbered(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    got = scratch.numbered(rows, "n", "k").collect()
    assert len(got) == 1000 and all(r.k == r.n for r in got)


def test_path_rules(spark):
    cases = {"a/tests/x.py": "test", "test_a.py": "test", "a_test.go": "test", "a.spec.ts": "test", "latest.py": "code", "Package.JSON": "config", "a/.env.local": "config", "jest.config.ts": "config", "x.config.js": "config", ".config": "code", "README.MD": "doc", "LICENSE-MIT": "doc", "license/x.py": "code", "src/contest/x.py": "code"}
    df = spark.createDataFrame(list(cases.items()), "path string, want string").withColumn("got", classify.file_type(F.col("path")))
    assert [(r.path, r.got) for r in df.collect()] == list(cases.items())
    skipped = {"node_modules/x": True, "a/dist/b.py": True, "dist": False, "mydist/b.py": False, "a/.git/b": True}
    df = spark.createDataFrame(list(skipped.items()), "path string, want boolean")
    assert {r.path: r.x for r in df.select("path", classify.in_skipped_dir(F.col("path")).alias("x")).collect()} == skipped


def test_benchmark_goes_on_after_an_error(spark, tmp_path, monkeypatch, capsys):
    """The loop over repositories, its sink and its totals, by the command."""
    from quarry import cli

    def parse(session, root, output):
        if root == "bad":
            raise OSError("not there")
        return pipeline.Parsed(session.createDataFrame([("a.py", 3), ("b.py", 4)], "path string, line_count int"), *[None] * 5)

    monkeypatch.setattr(pipeline, "parse", parse)
    monkeypatch.setattr(pipeline, "generate", lambda session, output: None)
    monkeypatch.setattr(pipeline, "assess", lambda session, output: (session.createDataFrame([(0.5,), (0.7,)], "composite_score double"), None))
    monkeypatch.setattr(cli.SparkSession, "builder", type("Builder", (), {"appName": lambda self, _: self, "config": lambda self, *_: self, "getOrCreate": lambda self: spark})())
    cli.main(["benchmark", "one", "bad", "two", "--output", str(tmp_path)])
    rows = {r.repo: r for r in spark.read.json(f"{tmp_path}/benchmark").collect()}
    assert set(rows) == {"one", "bad", "two"} and rows["one"].files == 2 and rows["one"].lines == 7 and rows["two"].score == pytest.approx(0.6)
    assert rows["bad"].error == "OSError: not there" and rows["one"].error is None
    totals = documents.benchmark_totals(repo.load(spark, f"{tmp_path}/benchmark", "json")).head()
    assert totals.failed == 1 and totals.score == pytest.approx(0.6) and "not there" in capsys.readouterr().out
