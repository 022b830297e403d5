"""Substring look-ups by grams against plain searches."""

import random
import time

from pyspark.sql import functions as F

from quarry.operators import evaluate, resolve


def test_mentions_equal_a_plain_search(spark):
    rng = random.Random(2)
    make = lambda n, letters: "".join(rng.choices(letters, k=n))
    long_text = make(1_000_000, "abcdefghij")
    texts = [long_text, "src/app.py is read\nby  main()", "", None, "x", "Ünïcödé 漢字 names", *(make(rng.randint(1, 900), "abc d\n.") for _ in range(25))]
    within = [long_text[k : k + n] for k, n in [(0, 3), (250, 12), (255, 2), (511, 300), (999_990, 10), (777_777, 1)]]
    asked = {"app.py", "main()", "read\nby", "by  main", "by main", "漢字", "字 n", "zzz", "x", "q", " ", "", *within, *(make(rng.randint(1, 7), "abc d\n.") for _ in range(80))}
    subjects = spark.createDataFrame([(a,) for a in [*asked, "app.py"]], "subject string")
    docs = spark.createDataFrame([(t,) for t in [*texts, texts[1]]], "text string")
    began = time.time()
    got = [r.subject for r in evaluate.mentioned(subjects, docs).collect()]
    assert time.time() - began < 60
    assert len(got) == len(set(got))
    assert set(got) == {a for a in asked if a.strip(" ") and any(a in t for t in texts if t)}
    assert evaluate.mentioned(subjects.limit(0), docs).count() == evaluate.mentioned(subjects, docs.limit(0)).count() == 0


def test_type_mentions_and_local_returns_equal_a_plain_search(spark):
    rng = random.Random(3)
    kinds = ["User", "Use", "List[User]", "dict[str, models.Job]", "J", "", None, "T_1", "Optional[JobList]"]
    functions = [(f"f{k % 2}.py", f"{'pkg.' * (k % 3 == 0)}{rng.choice(['User', 'Job', 'T', 'go'])}{k % 5 or ''}", rng.choice(kinds), [f"a: {rng.choice(kinds)}", "b"]) for k in range(60)]
    names = [(f"f{k % 2}.py", n, f"t{k}") for k, n in enumerate(["User", "Use", "Job", "ob", "T_1", "zzzzz", "", "List[User]"])]
    fs = spark.createDataFrame(functions, "file string, name string, return_type string, parameters array<string>")
    ns = spark.createDataFrame(names, "file string, name string, target string")
    want = sorted((f, a, n, t, r) for f, a, r, _ in functions for g, n, t in names if f == g and r is not None and n in r)
    assert sorted(map(tuple, resolve.type_mentions(fs, ns, "return_type").collect())) == want
    want = sorted((f, a, n, t, p) for f, a, _, ps in functions for p in ps for g, n, t in names if f == g and n in p)
    assert sorted(map(tuple, resolve.type_mentions(fs, ns, "parameters").collect())) == want
    want = sorted((f, a, b) for f, a, r, _ in functions for g, b, _, _ in functions if f == g and r is not None and b.split(".")[-1] in r and a != b)
    assert sorted(map(tuple, resolve.local_return_calls(fs).collect())) == want


def test_a_file_of_very_many_functions(spark):
    fs = spark.range(100_000).selectExpr("'big.py' as file", "concat('f', id) as name", "concat('list[T', id % 1000, ']') as return_type")
    ns = spark.range(1000).selectExpr("'big.py' as file", "concat('T', id, ']') as name", "'t' as target")
    assert resolve.type_mentions(fs, ns, "return_type").count() == 100_000


def test_names_are_valid_for_all_documents_or_one(spark):
    docs = spark.createDataFrame([("a", "`Known` `Other` `x/y.py`", ["e"]), ("b", "`other`", ["e"])], "name string, text string, entities array<string>")
    paths = spark.createDataFrame([("./x/y.py",)], "path string")
    every = evaluate.evaluate(docs, paths, spark.createDataFrame([("known",), ("KNOWN",)], "entity string"))
    assert {r.name: r.invalid_references for r in every.collect()} == {"a": ["Other"], "b": ["other"]}
    own = evaluate.evaluate(docs, paths, spark.createDataFrame([("a", "known"), ("b", "other")], "name string, entity string"))
    assert {r.name: r.invalid_references for r in own.collect()} == {"a": ["Other"], "b": []}


def test_texts_are_cut_as_the_library_cuts_them(spark):
    import base64

    import public_tokenizers
    import tiktoken

    from quarry.operators import chunks

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    table = {base64.b64decode(a): int(n) for a, n in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=chunks.WORDS, mergeable_ranks=table, special_tokens={})
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", None, "漢字 é" * 900]
    rows = spark.createDataFrame(list(enumerate(given)), "k int, text string")
    got = {r.k: r.t for r in rows.select("k", chunks.limited(F.col("text"), 100, chunks.Tokenizer(path)).alias("t")).collect()}
    cut = 0
    for k, text in enumerate(given):
        ids = library.encode_ordinary(text or "")
        want = text or ""
        if len(ids) > 100:
            want, cut = library.decode(ids[:100]) + f"\n[... truncated, {len(ids) - 100} tokens remaining]", cut + 1
        assert (got[k].text, got[k].n_tokens) == (want, len(library.encode_ordinary(want)))
    assert 0 < cut < len(given)
    plain = {r.k: r.t for r in rows.select("k", chunks.limited(F.col("text"), 100).alias("t")).collect()}
    assert plain[len(given) - 3].text == "" and "tokens remaining]" in plain[len(given) - 1].text


def test_a_graph_is_written_and_read_back(spark, tmp_path):
    from quarry.sources import repo

    nodes = spark.createDataFrame([("file::a", "file", "a", "a", 0, 0.5, None), ("func::a::é\n", "function", "é\n", "a", 1, 0.25, "m")], repo.NODE)
    edges = spark.createDataFrame([("file::a", "func::a::é\n", "CONTAINS")], repo.LINK)
    repo.save(repo.node_link(nodes, edges), f"{tmp_path}/g", form="text")
    (tmp_path / "g" / "more.txt").write_text('{"type": "node"}\n\nnot json\n{"type": "link", "src": "x"}\n{"type": "other"}\n')
    back, links, bad = repo.load_graph(spark, f"{tmp_path}/g")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, nodes.collect())) and links.collect() == edges.collect() and bad.count() == 4
    run = repo.stream_graph(spark, f"{tmp_path}/g").writeStream.format("memory").queryName("graph_lines").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.type: r["count"] for r in spark.table("graph_lines").groupBy("type").count().collect()} == {"node": 2, "link": 1, "bad": 4}


def test_documents_are_held_to_their_own_entities(spark):
    docs = spark.createDataFrame([("OVERVIEW.md", "t", None), ("m.md", "t", "m"), ("listed.md", "t", "l"), ("dependency-index.md", "t", None)], "name string, text string, module string")
    modules = spark.createDataFrame([("m", ["x"]), ("l", ["y", "z"])], "module string, entities array<string>")
    ranked = spark.createDataFrame([(f"n{k}", "m", 1.0 - k / 100, k) for k in range(30)], "name string, module string, pagerank double, ord long")
    got = {r.name: r.entities for r in evaluate.judged_entities(docs, modules, ranked).collect()}
    assert got == {"OVERVIEW.md": [f"n{k}" for k in range(20)], "m.md": [f"n{k}" for k in range(10)], "listed.md": ["y", "z"], "dependency-index.md": []}


def test_edges_of_a_hub_are_dealt_over_tasks(spark):
    from quarry.operators import graph

    hub = spark.range(20_000).selectExpr("'hub' as src", "concat('t', id) as dst")
    rest = spark.range(20_000).selectExpr("concat('s', id % 2000) as src", "concat('t', id) as dst")
    edges = hub.unionByName(rest)
    links = graph.links_of(edges, graph.degrees(edges, 40_000 // (4 * 8)))
    assert links.count() == 40_000 and links.groupBy("src", "part").count().agg(F.max("count")).head()[0] < 2 * 1250
    sizes = [r["count"] for r in links.repartition(8, "src", "part").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
    nodes = edges.selectExpr("src as id").union(edges.selectExpr("dst")).distinct()
    rank = graph.pagerank(nodes, edges, rounds=3)
    assert abs(rank.agg(F.sum("pagerank")).head()[0] - 1) < 1e-9 and not [t for t in spark.catalog.listTables() if t.name.startswith("quarry_")]
