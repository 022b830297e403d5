"""Repositories, documents and stored results as DataFrames."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from quarry.functions import classify
from quarry.functions.text import alias_map, line_count, module_slug
from quarry.sources import snapshots
from quarry.sources.folders import PUSHDOWN, RepositoryFiles, file_system
from quarry.sources.ship import ship

HISTORY = 200
TREE_DEPTH, TREE_LINES = 4, 300


def files(spark: SparkSession, root: str, *, languages: list[str] | None = None, ignore: list[str] | None = None, every: bool = False) -> DataFrame:
    """(path, file_type, language, size_bytes, line_count, content_hash, text) of a repository's files.

    Skipped folders are not entered and files over the size cap not read; with
    ``folders.PUSHDOWN`` set they are not even listed as rows.  ``every`` turns all
    skip rules off, as a census needs it.
    """
    ship(spark)
    spark.dataSource.register(RepositoryFiles)
    reader = spark.read.format("repository_files").option("path", root).option("push", spark.conf.get(PUSHDOWN)).option("listings", 2 * spark.sparkContext.defaultParallelism)
    rows = (reader if every else reader.option("prune", ",".join(classify.SKIP_DIRS)).option("most", classify.MAX_BYTES)).load()
    small = F.col("size_bytes") <= classify.MAX_BYTES  # on its own, so that it reaches the source
    kept = rows if every else rows.where(small).where(classify.is_discovered(F.col("path"), F.col("size_bytes"), languages, ignore))
    text = F.decode(F.when(F.is_valid_utf8("content"), F.col("content")).otherwise(F.make_valid_utf8("content").cast("binary")), "UTF-8")
    return kept.select("path", classify.file_type(F.col("path")).alias("file_type"), classify.language(F.col("path")).alias("language"), "size_bytes", line_count(text).alias("line_count"), F.sha2("content", 256).alias("content_hash"), text.alias("text"))


def census(paths: DataFrame) -> DataFrame:
    """(extension, n): how many paths have each extension, none included."""
    return paths.groupBy(F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("extension")).agg(F.count("*").alias("n"))


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """Lines of the ignore file at the root, none without one."""
    system, base = file_system(root)
    try:
        with system.open_input_stream(f"{base.rstrip('/')}/.gitignore") as f:
            return f.read().decode("utf-8", "replace").split("\n")
    except (FileNotFoundError, OSError):
        return []


def documents(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """(name, text) of Markdown files, flat or with all folders below; none where the folder is missing."""
    system, base = file_system(folder)
    if system.get_file_info(base).type.name == "NotFound":
        return spark.createDataFrame([], "name string, text string")
    ship(spark)
    spark.dataSource.register(RepositoryFiles)
    rows = spark.read.format("repository_files").option("path", folder).load().where(F.col("path").endswith(".md"))
    rows = rows if recursive else rows.where(~F.col("path").contains("/"))
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("text"))


def path_aliases(config: DataFrame, text: str = "text") -> DataFrame:
    return config.select(F.explode(alias_map(F.col(text))).alias("alias", "target"))


def go_module(lines: DataFrame, text: str = "text") -> DataFrame:
    """One row: the path of the first module line, empty without one."""
    found = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?m)^module\s+(\S+)", 1)
    return lines.agg(F.coalesce(F.max(F.nullif(found, F.lit(""))), F.lit("")).alias("module_path"))


def tree(paths: DataFrame, *, depth: int = TREE_DEPTH, most: int = TREE_LINES) -> DataFrame:
    """Indented listing: directories first, hidden ones but .github left out, cut at ``most`` lines."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda k: F.struct(F.slice(F.split("path", "/"), 1, k).alias("at"), (k == F.size(F.split("path", "/"))).alias("is_file")))
    rows = paths.select(F.explode(each).alias("e")).select("e.at", "e.is_file").distinct()
    shown = rows.where(~F.exists("at", lambda p: p.startswith(".") & (p != ".github")) | (F.col("is_file") & ~F.exists(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda p: p.startswith(".") & (p != ".github"))))
    last = F.size("at")
    key = F.array_join(F.transform("at", lambda p, k: F.concat(F.when((k + 1 == F.size("at")) & F.col("is_file"), "1").otherwise("0"), p)), "/")
    line = F.concat(F.repeat(F.lit("  "), last - 1), F.element_at("at", -1), F.when(F.col("is_file"), "").otherwise("/"))
    return shown.select(key.alias("key"), line.alias("line")).orderBy("key").limit(most)


class GitLog(DataSource):
    """``spark.read.format("git_log").option("path", repo)``: (commit_no, commit, path) of the last commits."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "commit_no int, commit string, path string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options.get("path", "."), int(self.options.get("commits", HISTORY)))


class _GitReader(DataSourceReader):
    def __init__(self, path: str, commits: int):
        self.path, self.commits = path, commits

    def read(self, partition) -> Iterator[tuple]:
        done = subprocess.run(["git", "-C", self.path, "log", f"-{self.commits}", "--name-only", "--format=%x00%H"], capture_output=True, text=True, timeout=60)
        for k, block in enumerate(done.stdout.split("\0")[1:]):
            commit, *names = block.strip().split("\n")
            for name in filter(None, names):
                yield k, commit, name


def churn(log: DataFrame, commits: int = HISTORY) -> DataFrame:
    return log.where(F.col("commit_no") < commits).groupBy("path").agg(F.count("*").alias("changes"))


def checkout(url: str, folder: str, branch: str | None = None) -> str:
    """Clone a repository with its full history, or pull it where it is already; the folder."""
    from pathlib import Path

    if (Path(folder) / ".git").exists():
        subprocess.run(["git", "-C", folder, "pull", "--ff-only"], check=True, timeout=600)
    else:
        subprocess.run(["git", "clone", *(["-b", branch] if branch else []), "--", url, folder], check=True, timeout=3600)
    return folder


def commit_distance(repo: str, since: str, timeout: int = 10) -> int | None:
    """Commits since a revision; None where git cannot tell."""
    try:
        done = subprocess.run(["git", "-C", repo, "rev-list", "--count", f"{since}..HEAD"], capture_output=True, text=True, timeout=timeout)
        return int(done.stdout) if done.returncode == 0 else None
    except (OSError, subprocess.TimeoutExpired):
        return None


def head_commit(repo: str, timeout: int = 10) -> str | None:
    """The current revision; None outside a work tree of git."""
    try:
        done = subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=timeout)
        return done.stdout.strip() if done.returncode == 0 else None
    except (OSError, subprocess.TimeoutExpired):
        return None


def store_vectors(chunks: DataFrame, path: str, key: str = "chunk_id") -> None:
    """The chunks of a repository by id; an embedding that the new rows lack is taken from the stored row of the same id and text.  Slots without a changed chunk stay as they are."""
    old = snapshots.read(chunks.sparkSession, path)
    if old is not None:
        kept = old.select(key, F.col("text").alias("_text"), F.col("embedding").alias("_old"))
        chunks = chunks.join(kept, key, "left").withColumn("embedding", F.coalesce("embedding", F.when(F.col("_text") == F.col("text"), F.col("_old")))).select(*chunks.columns)
    snapshots.replace(chunks, path, key)


def save(df: DataFrame, path: str, *, by: str | None = None, how: str = "overwrite", form: str = "parquet") -> None:
    writer = df.write.mode(how).format(form)
    (writer.partitionBy(by) if by else writer).save(path)


def load(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame | None:
    """A stored table, whole or in slots; None where there is none."""
    if form == "parquet" and (slotted := snapshots.read(spark, path)) is not None:
        return slotted
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.format(form).load(path)


def write_documents(docs: DataFrame, folder: str, *, slug: bool = True) -> None:
    """One Markdown file per document that is not empty, written by executors and without check sums that an edit by hand would break."""
    ship(docs.sparkSession)
    docs.sparkSession.dataSource.register(RepositoryFiles)
    name = module_slug(F.col("name")) if slug else F.col("name")
    rows = docs.where("trim(text) <> ''").select(F.concat(name, F.lit(".md")).alias("name"), F.col("text").cast("binary").alias("content"))
    rows.write.format("repository_files").mode("append").save(folder)


NODE = "id string, kind string, name string, file string, ord bigint, pagerank double, module string"
LINK = "src string, dst string, relation string"


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JSON lines of nodes and links, for exchange with graph libraries."""
    return nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), *nodes.columns)).alias("value")).unionByName(edges.select(F.to_json(F.struct(F.lit("link").alias("type"), *edges.columns)).alias("value")))


def graph_lines(lines: DataFrame, node: str = NODE, link: str = LINK) -> DataFrame:
    """(type, node, link, bad) of lines (value) as ``node_link`` writes them, of a table or a stream.

    ``bad`` holds a line that is no JSON, has another type or lacks its key; empty lines
    are left out.
    """
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parse = lambda kind: F.from_json("value", f"type string, {kind}, _bad string", strict)
    both = lines.where("trim(value) <> ''").select("value", parse(node).alias("n"), parse(link).alias("l"))
    kind = F.when((F.col("n.type") == "node") & F.col("n._bad").isNull() & F.col("n.id").isNotNull(), "node").when((F.col("l.type") == "link") & F.col("l._bad").isNull() & F.col("l.src").isNotNull() & F.col("l.dst").isNotNull(), "link").otherwise("bad")
    marked = both.select("value", kind.alias("type"), F.col("n").dropFields("type", "_bad").alias("node"), F.col("l").dropFields("type", "_bad").alias("link"))
    return marked.select("type", F.when(F.col("type") == "node", F.col("node")).alias("node"), F.when(F.col("type") == "link", F.col("link")).alias("link"), F.when(F.col("type") == "bad", F.col("value")).alias("bad"))


def load_graph(spark: SparkSession, path: str, node: str = NODE, link: str = LINK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and the lines that are neither, of a graph that ``node_link`` wrote."""
    rows = graph_lines(spark.read.text(path), node, link)
    return rows.where("type = 'node'").select("node.*"), rows.where("type = 'link'").select("link.*"), rows.where("type = 'bad'").select("bad")


def stream_graph(spark: SparkSession, folder: str, node: str = NODE, link: str = LINK) -> DataFrame:
    """``graph_lines`` of files that arrive in a folder."""
    return graph_lines(spark.readStream.text(folder), node, link)
