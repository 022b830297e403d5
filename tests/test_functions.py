"""Column functions on the cases that define them."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import classify, scores, signals, text
from quarry.plans import queries


def value(spark, column, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()) if columns else [F.lit(1).alias("one")]).select(column).head()[0]


@pytest.mark.parametrize(
    ("name", "slug"),
    [("auth", "auth"), ("api-layer", "api-layer"), ("My Module", "my-module"), ("hello_world", "hello-world"), ("special!@#chars", "specialchars"), ("multiple---hyphens", "multiple-hyphens"), ("  leading-trailing  ", "leading-trailing"), ("", "unnamed-module")],
)
def test_module_slug(spark, name, slug):
    assert value(spark, text.module_slug(F.lit(name))) == slug


@pytest.mark.parametrize(
    ("score", "iteration", "previous", "result"),
    [(0.90, 0, 0.0, "pass"), (0.60, 0, 0.0, "fix"), (0.50, 3, 0.48, "pass"), (0.70, 2, 0.69, "pass"), (0.75, 2, 0.60, "fix"), (0.85, 0, 0.0, "pass"), (0.84, 0, 0.0, "fix"), (None, None, None, "fix")],
)
def test_gate(spark, score, iteration, previous, result):
    given = [F.lit(score).cast("double"), F.lit(iteration).cast("int"), F.lit(previous).cast("double")]
    assert value(spark, scores.gate(*given)) == result


@pytest.mark.parametrize(("lines", "score"), [(20, 1.0), (35, 1.0), (60, 0.642857), (120, 0.357143)])
def test_conciseness(spark, lines, score):
    doc = "\n".join(f"Line {k}" for k in range(lines))
    assert value(spark, scores.conciseness(F.lit(doc))) == pytest.approx(score, abs=1e-5)


def test_coverage_accuracy_and_structure(spark):
    doc = F.lit("Use `login` from `src/auth/login.py`, `ghost` and `login`. ## See Also ## key files")
    names = F.array(F.lit("LOGIN"), F.lit("FooBar"))
    assert value(spark, scores.entity_coverage(doc, names)) == 0.5
    assert value(spark, scores.missing_entities(doc, names)) == ["FooBar"]
    assert value(spark, scores.entity_coverage(doc, F.array().cast("array<string>"))) == 1.0
    assert value(spark, scores.invalid_references(doc, names, F.array(F.lit("./src/auth/login.py")))) == ["ghost"]
    assert value(spark, scores.factual_accuracy(F.lit("plain"), names, names)) == 1.0
    assert value(spark, scores.structural_completeness(doc)) == 0.5


@pytest.mark.parametrize(
    ("path", "kind", "lang"),
    [("src/a.py", "code", "python"), ("tests/a.py", "test", "python"), ("src/test_a.py", "test", "python"), ("a.test.ts", "test", "typescript"), ("package.json", "config", None), ("Dockerfile", "config", None), (".env.local", "config", None), ("x.config.js", "config", "javascript"), ("README.md", "doc", None), ("LICENSE", "doc", None), ("a/b.rs", "code", "rust"), ("contest/a.go", "code", "go")],
)
def test_classification(spark, path, kind, lang):
    got = spark.range(1).select(classify.file_type(F.lit(path)), classify.language(F.lit(path))).head()
    assert tuple(got) == (kind, lang)


def test_ignore_patterns(spark):
    rows = spark.createDataFrame([(p,) for p in ("a/docs/x", "docs", "a.log", "b/a.log", "build/x", "src/build/x", "deep/a/b/c.txt")], "path string")
    kept = {r.path for r in rows.where(~classify.is_ignored(F.col("path"), ["docs/", "*.log", "/build", "deep/**/c.txt", "!x"])).collect()}
    assert kept == {"docs", "src/build/x"}


def test_signals_keep_one_per_group_and_line(spark):
    rows = spark.createDataFrame([("f", "x = 1  # TODO HACK: do not  remove\n# noqa\nplain\nTODOS\n")], "path string, text string")
    got = [tuple(r) for r in signals.line_signals(signals.lines(rows)).select("line_number", "grp", "category").orderBy("line_number", "grp").collect()]
    assert got == [(1, 0, "hack"), (1, 1, "important"), (2, 2, "rule_override")]


def test_text_functions(spark):
    assert value(spark, text.resolve_dots(F.lit("a/./b/../c"))) == "a/c"
    assert value(spark, text.normal_path(F.lit("./.github\\x"))) == "github/x"
    assert value(spark, text.backtick_references(F.lit("`a1` `b\nc` `a1` `` ` `"))) == ["a1", "b\nc"]
    assert value(spark, text.path_references(F.lit("`src/a.py` `b.py` `./c.md` `d`"))) == ["src/a.py", "./c.md"]
    assert value(spark, text.common_prefix_parts(F.lit("a/b/c"), F.lit("a/b/d"))) == 2
    assert value(spark, text.decorator_name(F.lit("app.route('/x')"))) == "route"
    assert tuple(value(spark, text.repository_of_url(F.lit("git@host.com:own/rep.git")))) == ("own", "rep")
    assert value(spark, text.alias_map(F.lit('{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}'))) == {"@": "src"}
    assert [value(spark, text.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]


def test_signals_query_covers_texts_with_carriage_returns_and_without_a_language(spark, tmp_path):
    texts = ["the one\r\nx\r\nThe token", "a\rthe token\rb\nof", "the\n", None, "", "License\r"]
    rows = [(k, t, None if k % 2 else "en") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["x12_signals"](spark, str(tmp_path)).collect()))
    assert got == [(0, 1, 0, "note"), (0, 3, 0, "hack"), (1, 1, 0, "note"), (1, 2, 1, "ordering"), (2, 1, 0, "note"), (5, 1, 0, "important")]
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["x12_signals"]).fetchall())
