"""String, path and format functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_slug(name: Column) -> Column:
    """A module's file name: lower case, spaces and underscores to hyphens, other marks dropped; never empty."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[\s_]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9-]", ""), "-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("unnamed-module"))


def module_of_document(name: Column) -> Column:
    return F.regexp_replace(name, r"\.md$", "")


def normal_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


def normal_path(path: Column) -> Column:
    """Slashes forward; leading dots and slashes (a character set, not a prefix) dropped."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^[./]+", "")


def resolve_dots(path: Column) -> Column:
    """``.`` and ``..`` parts folded."""

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(part.isin(".", ""), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def backtick_references(text: Column) -> Column:
    """Distinct references between backticks in order of appearance; they may cross lines."""
    found = F.transform(F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1)), lambda r: F.trim(r))
    return F.array_distinct(F.filter(found, lambda r: r != ""))


def path_references(text: Column) -> Column:
    """One-line backticked file references: an extension and a slash or leading dot; repeats kept."""
    found = F.regexp_extract_all(text, F.lit(r"`([^`\n]+\.[A-Za-z0-9]+)`"), F.lit(1))
    return F.filter(found, lambda r: r.contains("/") | r.startswith("."))


def replace_references(text: Column, fixes: Column) -> Column:
    """Fold an array of (old, new) over a text; a null ``new`` removes the backticked reference."""

    def step(acc: Column, fix: Column) -> Column:
        old = F.concat(F.lit("`"), fix["old"], F.lit("`"))
        return F.replace(acc, old, F.when(fix["new"].isNull(), "").otherwise(F.concat(F.lit("`"), fix["new"], F.lit("`"))))

    return F.aggregate(fixes, text, step)


def import_list(imports: Column) -> Column:
    """The first ten imports with at most five names each; ``none`` without any."""
    one = lambda i: F.when(F.size(i["names"]) > 0, F.concat(i["module"], F.lit(": "), F.array_join(F.slice(i["names"], 1, 5), ", "))).otherwise(i["module"])
    return F.when(F.size(imports) > 0, F.array_join(F.transform(F.slice(imports, 1, 10), one), "; ")).otherwise("none")


def short_label(node_id: Column) -> Column:
    return F.element_at(F.split(node_id, "::"), -1)


def decorator_name(decorator: Column) -> Column:
    return F.element_at(F.split(F.split_part(decorator, F.lit("("), F.lit(1)), r"\."), -1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def common_prefix_parts(a: Column, b: Column) -> Column:
    """How many leading parts two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))

    def step(acc: Column, eq: Column) -> Column:
        go = acc["go"] & eq
        return F.struct(go.alias("go"), (acc["n"] + go.cast("int")).alias("n"))

    return F.aggregate(same, F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def percent(x: Column) -> Column:
    return F.format_string("%.0f%%", x * 100)


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def markdown_table(rows: Column) -> Column:
    """Rows (source, target, edge_count, direction) as a Markdown table."""
    head = "| Source | Target | Edges | Direction |\n| --- | --- | --- | --- |\n"
    line = lambda r: F.concat(F.lit("| "), r["source"], F.lit(" | "), r["target"], F.lit(" | "), r["edge_count"].cast("string"), F.lit(" | "), r["direction"], F.lit(" |"))
    return F.concat(F.lit(head), F.array_join(F.transform(rows, line), "\n"))


def repository_of_url(url: Column) -> Column:
    """(owner, repo) of an HTTPS or SSH address; nulls where it is neither."""
    https, ssh = r"^https?://[^/]+/([^/]+)/([^/]+?)(?:\.git)?/?$", r"^git@[^:]+:([^/]+)/([^/]+?)(?:\.git)?$"
    part = lambda k: F.nullif(F.coalesce(F.nullif(F.regexp_extract(url, https, k), F.lit("")), F.regexp_extract(url, ssh, k)), F.lit(""))
    return F.struct(part(1).alias("owner"), part(2).alias("repo"))


def line_count(text: Column) -> Column:
    """Line feeds, and one more for a last line without one; an empty text has none."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return feeds + ((text != "") & ~text.endswith("\n")).cast("int")


def alias_map(paths_json: Column) -> Column:
    """Path aliases of a TypeScript configuration: first target each, ``/*`` endings cut."""
    plain = F.regexp_replace(paths_json, r"(?m)^\s*//.*$", "")
    raw = F.from_json(plain, "struct<compilerOptions: struct<paths: map<string, array<string>>>>")["compilerOptions"]["paths"]
    cut = lambda s: F.regexp_replace(s, r"/?\*$", "")
    return F.transform_values(F.transform_keys(raw, lambda k, v: cut(k)), lambda k, v: cut(F.element_at(v, 1)))


#: Characters of a gram, by which substrings are looked up, and of the blocks that texts are read in.
GRAM, BLOCK = 4, 256


def blocks(text: Column) -> Column:
    """A text as pieces of BLOCK characters, each with the first GRAM - 1 of the next: every gram lies in one; linear in the text's length."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    after = F.concat(F.slice(cut, F.lit(2), F.size(cut)), F.array(F.lit("")))
    return F.zip_with(cut, after, lambda a, b: F.concat(a, F.coalesce(F.left(b, F.lit(GRAM - 1)), F.lit(""))))


def grams(block: Column) -> Column:
    """All different strings of one to GRAM characters in a block."""
    at = F.sequence(F.lit(1), F.length(block))
    return F.when(F.length(block) > 0, F.array_distinct(F.flatten(F.transform(at, lambda k: F.array(*(block.substr(k, F.lit(n)) for n in range(1, GRAM + 1))))))).otherwise(F.array().cast("array<string>"))


def grams_of_name(name: Column) -> Column:
    """Grams that every text with ``name`` in it has: those of GRAM characters, for a shorter name itself."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name) - GRAM + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda k: name.substr(k, F.lit(GRAM))))
