"""Context chunks of entities, and filtered nearest-neighbour search over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import fixed, import_list
from quarry.operators import graph

BATCH, RESULTS, KEEP, TOP = 64, 30, 20, 10
TRUNCATE = 1500
#: How text is cut into words before ranks apply.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, object] = {}


def _or_none(values: Column) -> Column:
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.array_join(values, ", ")).otherwise("none")


def _body(content: Column, start: Column, end: Column, fallback: Column) -> Column:
    lines = F.slice(F.split(content, "\n"), start, F.greatest(end - start + 1, F.lit(1)))
    return F.when(content.isNull(), fallback).otherwise(F.array_join(lines, "\n"))


def _head(language: str = "language", file: str = "file_path", module: str = "module") -> list[Column]:
    return [F.concat(F.lit("# Language: "), F.coalesce(language, F.lit("unknown")), F.lit(" | File: "), F.col(file)), F.concat(F.lit("# Module: "), F.coalesce(module, F.lit("unknown"))), F.concat(F.lit("# Imports: "), import_list(F.col("imports")))]


def function_chunks(df: DataFrame) -> DataFrame:
    """Rows (file_path, language, module, imports, name, cls, cls_doc, signature, line_start, line_end, content, callers, callees, pagerank, position)."""
    owner = F.when(F.col("cls").isNotNull(), F.concat(F.lit("# Class: "), "cls", F.coalesce(F.concat(F.lit(" - "), F.substring("cls_doc", 1, 80)), F.lit(""))))
    rank = F.concat(F.lit("# PageRank: "), fixed(F.col("pagerank"), 6), F.lit(" (#"), F.col("position").cast("string"), F.lit(")"))
    text = F.concat_ws("\n", *_head(), owner, F.concat(F.lit("# Called by: "), _or_none(F.col("callers"))), F.concat(F.lit("# Calls: "), _or_none(F.col("callees"))), rank, F.lit(""), _body(F.col("content"), F.col("line_start"), F.col("line_end"), F.col("signature")))
    name = F.when(F.col("cls").isNotNull(), F.concat_ws(".", "cls", "name")).otherwise(F.col("name"))
    return _chunk(df, "function", name, text)


def class_chunks(df: DataFrame) -> DataFrame:
    """Rows (…, name, decorators, bases, docstring, methods array<string>)."""
    bases = F.when(F.size("bases") > 0, F.concat(F.lit("("), F.array_join("bases", ", "), F.lit(")"))).otherwise("")
    doc = F.substring(F.split_part(F.trim(F.coalesce("docstring", F.lit(""))), F.lit("\n"), F.lit(1)), 1, 200)
    body = F.when(F.size("methods") > 0, F.array_join(F.transform("methods", lambda m: F.concat(F.lit("    "), m)), "\n")).otherwise("    pass")
    rank = F.concat(F.lit("# PageRank: "), fixed(F.col("pagerank"), 6))
    text = F.concat_ws("\n", *_head(), rank, F.lit(""), F.nullif(F.array_join(F.transform("decorators", lambda d: F.concat(F.lit("@"), d)), "\n"), F.lit("")), F.concat(F.lit("class "), "name", bases, F.lit(":")), F.nullif(F.when(doc != "", F.concat(F.lit('    """'), doc, F.lit('"""'))).otherwise(""), F.lit("")), body)
    return _chunk(df, "class", F.col("name"), text)


def file_chunks(df: DataFrame) -> DataFrame:
    """Rows (…, exports, classes, functions array<string>, content)."""
    rank = F.concat(F.lit("# PageRank: "), fixed(F.col("pagerank"), 6))
    listed = [F.concat(F.lit(f"# {n}: "), _or_none(F.slice(F.col(c), 1, k) if k else F.col(c))) for n, c, k in (("Exports", "exports", 20), ("Classes", "classes", 0), ("Functions", "functions", 20))]
    text = F.concat_ws("\n", *_head(), *listed, rank, F.lit(""), F.array_join(F.slice(F.split(F.coalesce("content", F.lit("")), "\n"), 1, 50), "\n"))
    return _chunk(df, "file_summary", F.col("file_path"), text)


def _chunk(df: DataFrame, kind: str, name: Column, text: Column) -> DataFrame:
    key = F.concat_ws("::", F.lit(kind), F.col("file_path"), name)
    return df.select(key.alias("chunk_id"), "file_path", F.lit(kind).alias("entity_type"), name.alias("entity_name"), "language", F.coalesce("module", F.lit("unknown")).alias("module"), "pagerank", text.alias("text"))


def estimated_tokens(text: Column) -> Column:
    """A token estimate without a vocabulary: a quarter of the characters, words at least."""
    return F.greatest(F.ceil(F.length(text) / 4), F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))).cast("int")


class Tokenizer:
    """A byte vocabulary from a file of ranks (base64 tokens and numbers), loaded once a process."""

    def __init__(self, ranks: str):
        self.ranks = ranks

    def _encoding(self):
        import base64

        import tiktoken

        if self.ranks not in _ENCODERS:
            with open(self.ranks, "rb") as f:
                table = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
            _ENCODERS[self.ranks] = tiktoken.Encoding("chunks", pat_str=WORDS, mergeable_ranks=table, special_tokens={})
        return _ENCODERS[self.ranks]

    def __call__(self, texts: list[str]) -> list[int]:
        encode = self._encoding().encode_ordinary
        return [len(encode(text)) for text in texts]

    def cut(self, texts: list[str], most: int) -> list[tuple[str, int]]:
        """Each text, cut after ``most`` tokens with a notice of what is left, and its tokens then; a token that ends inside a character leaves a replacement mark.

        The ids of one text are held at a time.
        """
        encoding, out = self._encoding(), []
        for text in texts:
            ids = encoding.encode_ordinary(text)
            if len(ids) > most:
                text = encoding.decode(ids[:most]) + notice(len(ids) - most)
                out.append((text, len(encoding.encode_ordinary(text))))
            else:
                out.append((text, len(ids)))
        return out


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts cross to Python by the thousand, not ten thousand, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def notice(left: int) -> str:
    return f"\n[... truncated, {left} tokens remaining]"


def limited(text: Column, most: int = TRUNCATE, tokenizer: Callable[[list[str]], list[int]] | None = None) -> Column:
    """(text, n_tokens): a text of more than ``most`` tokens is cut there, with a notice; null counts as empty.

    A ``Tokenizer`` counts and cuts in one pass of an Arrow function.  Without one, or
    with a function that only counts, tokens stand for four characters where a text is
    cut.
    """
    if hasattr(tokenizer, "cut"):

        @F.pandas_udf("text string, n_tokens int")
        def exact(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(tokenizer.cut(texts.fillna("").tolist(), most), columns=["text", "n_tokens"])

        return exact(text)
    given = F.coalesce(text, F.lit(""))
    left = token_counts(given, tokenizer) - most
    shown = F.when(left > 0, F.concat(F.substring(given, 1, most * 4), F.lit("\n[... truncated, "), left.cast("string"), F.lit(" tokens remaining]"))).otherwise(given)
    return F.struct(shown.alias("text"), token_counts(shown, tokenizer).alias("n_tokens"))


def token_counts(text: Column, count: Callable[[list[str]], list[int]] | None = None) -> Column:
    """Tokens by an injected batch tokenizer, estimated without one."""
    if count is None:
        return estimated_tokens(text)

    @F.pandas_udf("int")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(count(texts.fillna("").tolist()))

    return tokens(text)


def of_repository(files: DataFrame, extractions: DataFrame, nodes: DataFrame, edges: DataFrame, *, count: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """Chunks of all functions, methods, classes and files of a parsed repository, one row a ``chunk_id``.

    A rank is the node's, 0 where it has none; its position counts the better ones
    among the nodes that the summary of the graph lists.
    """
    listed = graph.top_by_kind(nodes).agg(F.array_sort(F.collect_list("pagerank")).alias("tops"))  # a hundred ranks at most
    near = nodes.select("id", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")).join(graph.callers(edges, nodes), "id", "left").join(graph.callees(edges, nodes), "id", "left")
    own = nodes.where("kind = 'file'").select(F.col("file").alias("path"), "module")
    base = extractions.join(files.select("path", "language", F.col("text").alias("content")), "path") if "language" not in extractions.columns else extractions.join(files.select("path", F.col("text").alias("content")), "path")
    base = base.join(own, "path", "left").withColumn("file_path", F.col("path"))
    head = ["file_path", "language", "module", "imports", "content"]

    def ranked(df: DataFrame, key: Column) -> DataFrame:
        found = df.withColumn("id", key).join(near, "id", "left").crossJoin(F.broadcast(listed))  # one row
        return found.withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0))).withColumn("position", graph.rank_position(F.col("pagerank"), F.col("tops")))

    path = F.col("file_path")
    functions = base.select(*head, F.explode("functions").alias("f")).select(*head, "f.name", "f.qualified_name", "f.signature", "f.line_start", "f.line_end", F.lit(None).cast("string").alias("cls"), F.lit(None).cast("string").alias("cls_doc"))
    owned = base.select(*head, F.explode("classes").alias("c")).select(*head, F.col("c.name").alias("cls"), F.col("c.docstring").alias("cls_doc"), F.explode("c.methods").alias("m"))
    methods = owned.select(*head, "m.name", "m.qualified_name", "m.signature", "m.line_start", "m.line_end", "cls", "cls_doc")
    free = functions.join(methods.select("file_path", "qualified_name", "line_start"), ["file_path", "qualified_name", "line_start"], "left_anti")  # languages that list methods among functions too
    key = F.when(F.col("cls").isNull(), graph.node_id("func", path, F.col("name"))).otherwise(graph.node_id("func", path, graph.method_name(F.col("cls"), F.col("name"))))
    classes = base.select(*head, F.explode("classes").alias("c")).select(*head, "c.name", "c.decorators", "c.bases", "c.docstring", F.transform("c.methods", lambda m: m["signature"]).alias("methods"))
    names = lambda column: F.transform(column, lambda x: x["name"])
    whole = base.select(*head, names("exports").alias("exports"), names("classes").alias("classes"), names("functions").alias("functions"))
    kinds = [function_chunks(ranked(free.select(*methods.columns).unionByName(methods), key)), class_chunks(ranked(classes, graph.node_id("class", path, F.col("name")))), file_chunks(ranked(whole, graph.node_id("file", path)))]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).dropDuplicates(["chunk_id"])
    return every.withColumn("_t", limited(F.col("text"), tokenizer=count)).withColumns({"text": F.col("_t.text"), "n_tokens": F.col("_t.n_tokens")}).drop("_t")


def embedded(df: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None, text: str = "text", batch: int = BATCH) -> DataFrame:
    """Adds ``embedding`` by an injected embedder in batches of ``batch``; null without one."""
    if embed is None:
        return df.withColumn("embedding", F.lit(None).cast("array<float>"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), batch):
                piece = pdf.iloc[lo : lo + batch]
                yield piece.assign(embedding=embed(piece[text].fillna("").tolist()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", embedding array<float>"
    return df.mapInPandas(run, schema)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(vectors: DataFrame, query: DataFrame, *, where: Column | None = None, on: str | None = None, k: int = KEEP, fetch: int = RESULTS, key: str = "vec_id") -> DataFrame:
    """The ``k`` most similar rows to each query vector (query_id, query), after a filter on the rows.

    With ``on``, a query meets the rows of its own value of that column only.
    Queries are given and few beside the rows; each task keeps ``k`` rows a query
    before the final ones meet, by Spark's group limit.
    """
    rows = vectors.where(where) if where is not None else vectors
    scored = (rows.join(query, on) if on else rows.crossJoin(query)).withColumn("similarity", cosine(F.col("embedding"), F.col("query")))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= min(k, fetch))
