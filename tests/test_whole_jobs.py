"""Registered queries over small tables against their SQL, and that they do their work once."""

import duckdb
import pytest

from quarry.operators import chunks, graph
from quarry.plans import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Five regions of five nations, with customers, suppliers, parts and line items."""
    folder = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    for name, sql in {
        "region": "SELECT i AS r_regionkey, ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][i + 1] AS r_name FROM range(5) t(i)",
        "nation": "SELECT i::INT AS n_nationkey, 'NATION' || i AS n_name, i % 5 AS n_regionkey FROM range(25) t(i)",
        "customer": "SELECT i AS c_custkey, 'Customer#' || i AS c_name, (i * 7 % 25)::INT AS c_nationkey FROM range(60) t(i)",
        "supplier": "SELECT i AS s_suppkey, 'Supplier#' || i AS s_name, (i * 3 % 25)::INT AS s_nationkey FROM range(30) t(i)",
        "part": "SELECT i AS p_partkey, 'part' || i AS p_name FROM range(40) t(i)",
        "orders": "SELECT i AS o_orderkey, i * 11 % 60 AS o_custkey FROM range(200) t(i)",
        "lineitem": "SELECT i * 13 % 200 AS l_orderkey, i * i % 30 AS l_suppkey FROM range(700) t(i)",
    }.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def by_sql(tables: str, name: str) -> list[tuple]:
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return sorted(con.execute(queries.ORACLES[name]).fetchall())


def by_spark(spark, tables: str, name: str) -> list[tuple]:
    return sorted(map(tuple, queries.QUERIES[name](spark, tables).collect()))


def test_common_prefixes_of_all_pairs(spark, tables):
    got = by_spark(spark, tables, "c20_common_prefix")
    assert len(got) == 25 * 25 and got == by_sql(tables, "c20_common_prefix")


def test_synthesis_reads_the_crossing_edges_once(spark, tables, monkeypatch):
    calls, crossing = [], graph.crossing_edges
    monkeypatch.setattr(graph, "crossing_edges", lambda *a: calls.append(1) or crossing(*a))
    assert by_spark(spark, tables, "l13_c25_synthesis") == by_sql(tables, "l13_c25_synthesis")
    assert len(calls) == 1


def test_module_edges_read_the_edges_once(spark, tables, tmp_path):
    assert by_spark(spark, tables, "g13_k7_module_edges") == by_sql(tables, "g13_k7_module_edges")
    rows = [(f"a::{k}", f"b::{k % 7}", "CALLS") for k in range(90)] + [(f"a::{k}", f"a::{k}", "IMPORTS") for k in range(5)] + [("x::a::3", "b::3", "CALLS"), ("a::1", "b::1", "CONTAINS")]
    spark.createDataFrame(rows, "src string, dst string, relation string").write.parquet(f"{tmp_path}/edges")
    modules = spark.createDataFrame([(f"a::{k}", "m") for k in range(90)] + [(f"b::{k}", "n" if k % 2 else None) for k in range(7)] + [("x::a::3", "m")], "id string, module string")
    found = graph.module_subgraphs(spark.read.parquet(f"{tmp_path}/edges"), modules)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [src") == 1
    label = lambda s, d, r: f"{s.split('::')[-1]} -{r}-> {d.split('::')[-1]}"
    want = {"m": sorted({label(*r) for r in rows if r[2] != "CONTAINS"})[:60], "n": sorted({label(*r) for r in rows if r[2] == "CALLS" and r[1] in ("b::1", "b::3", "b::5")})[:60]}
    got = {(r.module, r.position, r.label) for r in found.collect()}
    assert got == {(m, k + 1, x) for m in want for k, x in enumerate(want[m])} and len(want["m"]) == 60


def test_edges_are_dealt_without_a_join_of_all_sources(spark, tables):
    edges = spark.range(4000).selectExpr("CASE WHEN id % 4 = 0 THEN 'hub' ELSE concat('s', id % 50) END AS src", "concat('t', id) AS dst")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.links_of(edges, graph.degrees(edges, 250))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert by_spark(spark, tables, "g4_pagerank") == [(i, pytest.approx(p, abs=2e-6)) for i, p in by_sql(tables, "g4_pagerank")]


def test_a_tokenizer_holds_the_ids_of_one_text_at_a_time(monkeypatch):
    class Encoding:
        def encode_ordinary(self, text):
            return list(text)

        def decode(self, ids):
            return "".join(ids)

        def __getattr__(self, name):  # no call that takes all texts of a batch together
            raise AssertionError(name)

    tokenizer = chunks.Tokenizer("none")
    monkeypatch.setattr(tokenizer, "_encoding", lambda: Encoding())
    shown = "abc" + chunks.notice(2)
    assert tokenizer.cut(["abcde", "", "ab"], 3) == [(shown, len(shown)), ("", 0), ("ab", 2)] and tokenizer(["abc", ""]) == [3, 0]
