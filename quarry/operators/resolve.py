"""Symbols, imports and inferred calls as joins.

imports: (imp long, file, language, module, names array<string>); files: (path).
First-match searches become one row per candidate with its place in the search,
an equi join with the files, and a minimum per import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.functions.text import basename, decorator_name, resolve_dots
from quarry.sources.scratch import cut

# Fixed values.
PYTHON_EXTERNAL = """
os sys re json math pathlib typing collections functools itertools abc dataclasses enum hashlib logging unittest pytest asyncio
datetime io subprocess socket http urllib shutil copy time textwrap contextlib importlib inspect traceback argparse configparser
csv sqlite3 struct tempfile threading multiprocessing concurrent queue signal pprint string secrets uuid random decimal fractions
statistics operator bisect heapq array weakref types pickle shelve glob fnmatch linecache tokenize pdb profile timeit warnings
django flask fastapi celery requests httpx aiohttp sqlalchemy alembic pydantic boto3 botocore numpy pandas scipy sklearn tensorflow
torch transformers click typer rich uvicorn gunicorn starlette jinja2 marshmallow sentry_sdk redis psycopg2 pymongo motor stripe
openai anthropic langchain networkx matplotlib pillow PIL yaml toml
""".split()
SCRIPT_EXTERNAL = """
react next vue angular svelte express koa hapi lodash underscore axios node-fetch zod yup joi prisma drizzle typeorm sequelize
mongoose tailwindcss postcss webpack vite esbuild rollup jest vitest mocha chai cypress playwright typescript ts-node tslib path fs
os http https url util stream crypto child_process events buffer net dns tls querystring assert zlib cluster worker_threads
""".split()
GO_STANDARD = """
fmt os io net log math sort sync time strings strconv encoding bytes bufio crypto context errors flag path regexp runtime testing
reflect unsafe database html text archive compress container debug embed go hash image index mime plugin unicode
""".split()
ALIAS_SCOPES = ["@", "@app", "@lib", "@src", "@components"]
EXTENSIONS = {"typescript": [".ts", ".tsx", ".js", ".jsx"], "javascript": [".js", ".jsx", ".ts", ".tsx"]}


def is_external(module: Column, lang: Column) -> Column:
    python = F.split_part(module, F.lit("."), F.lit(1)).isin(PYTHON_EXTERNAL)
    top = F.split_part(module, F.lit("/"), F.lit(1))
    scoped = ~(module.contains("/") & top.isin(ALIAS_SCOPES))
    script = F.when(module.rlike("^[./]"), False).when(module.startswith("@"), scoped).otherwise(top.isin(SCRIPT_EXTERNAL))
    go = top.isin(GO_STANDARD) | top.contains(".")
    return F.when(lang == "python", python).when(lang.isin("typescript", "javascript"), script).when(lang == "go", go).otherwise(False)


def _first_found(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(imp, target): the file of the earliest candidate that exists; candidates is (imp, tries array<string>)."""
    tries = candidates.select("imp", F.posexplode("tries").alias("prio", "path"))
    return tries.join(files.select("path"), "path").groupBy("imp").agg(F.min_by("path", "prio").alias("target"))


def _suffix_found(left: DataFrame, files: DataFrame, bare: bool) -> DataFrame:
    """(imp, target): the least path that ends with the import's ``tail``.

    The last part of a path is the join key, so the ends are compared within one
    name only.  A tail that begins inside a file name (its first part is the only
    one) is looked up by every ending of the name.
    """
    stem = F.regexp_replace("path", r"\.[^./]*$", "") if bare else F.col("path")
    named = files.select("path", stem.alias("stem")).withColumn("last", basename(F.col("stem")))
    whole = left.where(F.col("tail").contains("/")).withColumn("last", basename(F.col("tail")))
    one = left.where(~F.col("tail").contains("/")).withColumnRenamed("tail", "ending")
    deep = whole.join(named, "last").where(F.expr("endswith(stem, tail)")).select("imp", "path")
    endings = named.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("last")), lambda k: F.expr("last").substr(k, F.length("last")))).alias("ending"))
    flat = one.join(endings, "ending").select("imp", "path")
    least = [df.groupBy("imp").agg(F.min("path").alias(name)) for df, name in ((deep, "a"), (flat, "b"))]
    return least[0].join(least[1], "imp", "full_outer").select("imp", F.least("a", "b").alias("target"))


def python_candidates(module: Column, names: Column, bases: list[str]) -> Column:
    stem = F.replace(module, F.lit("."), F.lit("/"))
    tries = []
    for base in bases:
        at = F.concat(F.lit(f"{base}/"), stem) if base else stem
        tries.append(F.concat(F.array(F.concat(at, F.lit("/__init__.py")), F.concat(at, F.lit(".py"))), _inside(at, names)))
    return F.concat(*tries)


def _inside(at: Column, names: Column) -> Column:
    def one(name: Column) -> Column:
        return F.array(F.concat(at, F.lit("/"), name, F.lit(".py")), F.concat(at, F.lit("/"), name, F.lit("/__init__.py")))

    return F.flatten(F.transform(names, one))


def resolve_python(imports: DataFrame, files: DataFrame, bases: list[str] | None = None) -> DataFrame:
    exact = cut(_first_found(imports.select("imp", python_candidates(F.col("module"), F.col("names"), bases or [""]).alias("tries")), files))
    left = imports.join(exact.select("imp"), "imp", "left_anti")
    stem = F.regexp_replace(F.replace("module", F.lit("."), F.lit("/")), "^/+", "/")
    tails = left.select("imp", F.explode(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))).alias("tail"))
    return _labelled(imports, exact, _suffix_found(tails, files, bare=False))


def resolve_script(imports: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    module = F.col("module")
    for alias, target in reversed(list((aliases or {}).items())):
        module = F.when(F.col("module").startswith(alias), F.concat(F.lit(target), F.col("module").substr(F.lit(len(alias) + 1), F.length("module")))).otherwise(module)
    parent = F.regexp_replace("file", "/?[^/]*$", "")
    path = F.when(module.startswith("."), resolve_dots(F.concat(parent, F.lit("/"), module))).otherwise(module)
    at = imports.withColumn("at", F.regexp_replace(path, "^[./]+", ""))

    def tries(extensions: list[str]) -> Column:
        return F.array(*(F.concat("at", F.lit(e)) for e in extensions), F.col("at"), *(F.concat("at", F.lit(f"/index{e}")) for e in extensions))

    found = cut(_first_found(at.select("imp", F.when(F.col("language") == "typescript", tries(EXTENSIONS["typescript"])).otherwise(tries(EXTENSIONS["javascript"])).alias("tries")), files))
    left = at.join(found.select("imp"), "imp", "left_anti").select("imp", F.col("at").alias("tail"))
    return _labelled(imports, found, _suffix_found(left, files, bare=True))


def resolve_go(imports: DataFrame, files: DataFrame, module_path: str = "") -> DataFrame:
    """Imports below the module path resolve to the package directory, if any file lies under it."""
    inner = F.regexp_replace(F.when(F.col("module").startswith(module_path), F.col("module").substr(F.lit(len(module_path) + 1), F.length("module"))).otherwise(F.col("module")), "^/+", "")
    parts = F.split("path", "/")
    dirs = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("target")).distinct()
    found = imports.withColumn("target", inner).join(dirs, "target").select("imp", "target")
    return _labelled(imports, found, found.limit(0))


def _labelled(imports: DataFrame, exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    both = imports.join(exact.withColumnRenamed("target", "_e"), "imp", "left").join(fuzzy.withColumnRenamed("target", "_f"), "imp", "left")
    kind = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_f").isNotNull(), "fuzzy").otherwise("unresolved")
    return both.select(*imports.columns, F.coalesce("_e", "_f", "module").alias("target"), kind.alias("resolution"))


def resolve_imports(imports: DataFrame, files: DataFrame, *, bases: list[str] | None = None, aliases: dict[str, str] | None = None, go_module: str = "") -> DataFrame:
    """Each import with its target and one of exact, fuzzy, external, unresolved; Rust and Java stay unresolved."""
    lang, known = F.col("language"), F.lit(True)
    if go_module:
        known = ~((lang == "go") & F.col("module").startswith(go_module))
    outside = is_external(F.col("module"), lang) & known
    if not go_module:
        outside &= lang != "go"  # every path starts with an empty module path
    external = imports.where(outside).select("*", F.col("module").alias("target"), F.lit("external").alias("resolution"))
    inner = imports.where(~outside)
    other = inner.where(lang.isin("rust", "java")).select("*", F.col("module").alias("target"), F.lit("unresolved").alias("resolution"))
    return (
        external.unionByName(resolve_python(inner.where(lang == "python"), files, bases))
        .unionByName(resolve_script(inner.where(lang.isin("typescript", "javascript")), files, aliases))
        .unionByName(resolve_go(inner.where(lang == "go"), files, go_module))
        .unionByName(other)
    )


def import_names(resolved: DataFrame) -> DataFrame:
    """(file, name, target): imported names of resolved imports, the last one wins; a module's short name only where no name has it."""
    ok = resolved.where(F.col("resolution").isin("exact", "fuzzy"))
    named = ok.select("file", F.explode("names").alias("name"), "target", F.lit(1).alias("level"), F.col("imp").alias("o"))
    short = F.element_at(F.split("module", r"[./]"), -1)
    own = ok.select("file", short.alias("name"), "target", F.lit(0).alias("level"), (-F.col("imp")).alias("o")).where("name <> ''")
    both = named.unionByName(own)
    return both.groupBy("file", "name").agg(F.max_by("target", F.struct("level", "o")).alias("target"))


def method_calls(methods: DataFrame) -> DataFrame:
    """Public methods of a class are taken to call its private ones; methods is (file, cls, name)."""
    a, b = methods.select("file", "cls", F.col("name").alias("caller")), methods.select("file", "cls", F.col("name").alias("callee"))
    private = F.col("callee").startswith("_") & (~F.col("callee").startswith("__") | (F.col("callee") == "__init__"))
    return a.join(b, ["file", "cls"]).where(~F.col("caller").startswith("_") & private & (F.col("caller") != F.col("callee")))


def decorator_calls(functions: DataFrame, names: DataFrame) -> DataFrame:
    """(file, name, used, target) where a decorator's base name is imported; functions is (file, name, decorators)."""
    used = functions.select("file", "name", F.explode("decorators").alias("d")).withColumn("used", decorator_name(F.col("d")))
    return used.join(names.select("file", F.col("name").alias("used"), "target"), ["file", "used"]).select("file", "name", "used", "target")


def contained(values: DataFrame, names: DataFrame) -> DataFrame:
    """(file, value, used): the different names of a file that occur in its values; values is (file, value), names (file, used).

    Each different value is read once, however many functions have it, and cut into
    its short strings; a name meets it by its first ones, so rows of one file are
    spread by these and no value is compared with a name it cannot hold.  An empty
    name is in every value.
    """
    different = values.where("value is not null").select("file", "value").distinct()
    piece = F.explode(text.blocks(F.col("value"))).alias("block")
    cut_up = different.select("file", "value", piece).select("file", "value", F.explode(text.grams(F.col("block"))).alias("key")).distinct()
    keyed = names.where("used is not null").select("file", "used").distinct().withColumn("key", F.left("used", F.lit(text.GRAM)))
    found = cut_up.join(keyed.where("key <> ''"), ["file", "key"]).where(F.col("value").contains(F.col("used"))).select("file", "value", "used")
    return found.unionByName(different.join(keyed.where("key = ''"), "file").select("file", "value", "used"))


def type_mentions(functions: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """(file, name, used, target, value) where a return type or parameter contains an imported name, within a file."""
    given = functions.select("file", "name", F.explode(column).alias("value")) if dict(functions.dtypes)[column].startswith("array") else functions.select("file", "name", F.col(column).alias("value"))
    known = names.select("file", F.col("name").alias("used"), "target")
    return given.join(contained(given, known), ["file", "value"]).join(known, ["file", "used"]).select("file", "name", "used", "target", "value")


def super_calls(methods: DataFrame, bases: DataFrame, names: DataFrame) -> DataFrame:
    """(file, cls, name, target, base): methods that an imported base class has too; bases is (file, cls, base)."""
    known = bases.join(names.select("file", F.col("name").alias("base"), "target"), ["file", "base"])
    above = methods.select(F.col("file").alias("target"), F.col("cls").alias("base"), "name")
    return methods.join(known, ["file", "cls"]).join(above, ["target", "base", "name"]).select("file", "cls", "name", "target", "base")


def local_return_calls(functions: DataFrame) -> DataFrame:
    """(file, name, callee): a function of the file that another one's return type names (last dotted part)."""
    last = F.element_at(F.split("callee", r"\."), -1)
    other = functions.select("file", F.col("name").alias("callee")).withColumn("used", last)
    given = functions.select("file", "name", F.col("return_type").alias("value"))
    return given.join(contained(given, other), ["file", "value"]).join(other, ["file", "used"]).where("name <> callee").select("file", "name", "callee")


def resolve_callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``resolved``: the exact qualified name, else the only file with that short name, else the wanted file's, else null.

    calls: (call, callee, target_file); symbols: (qname, short_name, file).
    """
    exact = symbols.select(F.col("qname").alias("callee"), F.col("qname").alias("exact")).distinct()
    short = symbols.groupBy("short_name").agg(F.min("qname").alias("only"), F.count_distinct("file").alias("n"))
    there = symbols.groupBy(F.col("short_name"), F.col("file").alias("target_file")).agg(F.min("qname").alias("there"))
    named = calls.withColumn("short_name", F.element_at(F.split(F.element_at(F.split("callee", "::"), -1), r"\."), -1))
    found = named.join(exact, "callee", "left").join(short, "short_name", "left").join(there, ["short_name", "target_file"], "left")
    return found.select(*calls.columns, F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")), "there").alias("resolved"))


def resolution_rate(calls: DataFrame) -> DataFrame:
    """One row: the resolved share of all calls, 1 without calls."""
    return calls.agg(F.coalesce(F.try_divide(F.count("resolved").cast("double"), F.count("*")), F.lit(1.0)).alias("rate"))
