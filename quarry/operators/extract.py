"""Structural extraction: one nested row per source file.

Python is read with its own syntax tree, other languages by ``scanner``.  Both run
in Arrow batches, the only Python on this path.  A file that cannot be read gives
an empty record with its error.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import signals
from quarry.functions.text import line_count
from quarry.operators.scanner import HTTP, READERS

FUNCTION = "struct<name:string,qualified_name:string,signature:string,line_start:int,line_end:int,docstring:string,decorators:array<string>,is_async:boolean,parameters:array<string>,return_type:string>"
CLASS = f"struct<name:string,line_start:int,line_end:int,bases:array<string>,docstring:string,decorators:array<string>,methods:array<{FUNCTION}>>"
FIELDS = {
    "functions": f"array<{FUNCTION}>",
    "classes": f"array<{CLASS}>",
    "imports": "array<struct<module:string,names:array<string>,is_relative:boolean,alias:string>>",
    "type_defs": "array<struct<name:string,kind:string,line_start:int,line_end:int>>",
    "exports": "array<struct<name:string,kind:string>>",
    "constants": "array<struct<name:string,value:string,line:int>>",
    "route_handlers": "array<struct<path:string,method:string,handler_function:string>>",
    "db_models": "array<struct<name:string,fields:array<string>>>",
}
SCHEMA = "path string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", error string"
UPPER = re.compile(r"^[A-Z][A-Z0-9_]*$")
ORM_BASES = ["Base", "Model", "DeclarativeBase", "SQLModel", "Document"]


def _function(node: ast.AST, source: str, owner: str | None = None) -> dict:
    params = [ast.unparse(a) for a in [*node.args.posonlyargs, *node.args.args]]
    params += [f"*{node.args.vararg.arg}"] if node.args.vararg else []
    params += [ast.unparse(a) for a in node.args.kwonlyargs]
    params += [f"**{node.args.kwarg.arg}"] if node.args.kwarg else []
    returns = ast.unparse(node.returns) if node.returns else None
    is_async = isinstance(node, ast.AsyncFunctionDef)
    head = f"{'async ' if is_async else ''}def {node.name}({', '.join(params)})" + (f" -> {returns}" if returns else "")
    return {"name": node.name, "qualified_name": f"{owner}.{node.name}" if owner else node.name, "signature": head, "line_start": node.lineno, "line_end": node.end_lineno, "docstring": ast.get_docstring(node), "decorators": [ast.unparse(d) for d in node.decorator_list], "is_async": is_async, "parameters": params, "return_type": returns}


def _assigned(node: ast.AST) -> tuple[str, ast.AST] | None:
    if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
        return node.targets[0].id, node.value
    if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and node.value is not None:
        return node.target.id, node.value
    return None


def python_record(source: str) -> dict:
    tree = ast.parse(source)
    out: dict = {k: [] for k in FIELDS}
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    exported = None
    for node in tree.body:
        if isinstance(node, functions):
            out["functions"].append(_function(node, source))
        elif isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases]
            out["classes"].append({"name": node.name, "line_start": node.lineno, "line_end": node.end_lineno, "bases": bases, "docstring": ast.get_docstring(node), "decorators": [ast.unparse(d) for d in node.decorator_list], "methods": [_function(m, source, node.name) for m in node.body if isinstance(m, functions)]})
            kind = next((k for b, k in (("Protocol", "protocol"), ("TypedDict", "type_alias"), ("Enum", "enum"), ("IntEnum", "enum"), ("StrEnum", "enum")) if any(x.split(".")[-1] == b for x in bases)), None)
            if kind:
                out["type_defs"].append({"name": node.name, "kind": kind, "line_start": node.lineno, "line_end": node.end_lineno})
            if any(b.split(".")[-1] in ORM_BASES for b in bases):
                fields = [t[0] for t in map(_assigned, node.body) if t] + [n.target.id for n in node.body if isinstance(n, ast.AnnAssign) and n.value is None and isinstance(n.target, ast.Name)]
                out["db_models"].append({"name": node.name, "fields": fields})
        elif (pair := _assigned(node)) is not None:
            name, value = pair
            if name == "__all__" and isinstance(value, (ast.List, ast.Tuple)):
                exported = [e.value for e in value.elts if isinstance(e, ast.Constant)]
            elif UPPER.match(name):
                out["constants"].append({"name": name, "value": ast.unparse(value)[:200], "line": node.lineno})
            elif isinstance(node, ast.AnnAssign) and "TypeAlias" in ast.unparse(node.annotation):
                out["type_defs"].append({"name": name, "kind": "type_alias", "line_start": node.lineno, "line_end": node.end_lineno})
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "names": [], "is_relative": False, "alias": a.asname} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["imports"].append({"module": "." * node.level + (node.module or ""), "names": [a.name for a in node.names], "is_relative": node.level > 0, "alias": None})
        elif isinstance(node, functions):
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in [*HTTP, "route"] and d.args and isinstance(d.args[0], ast.Constant):
                    methods = [d.func.attr.upper()]
                    if d.func.attr == "route":
                        given = next((k.value for k in d.keywords if k.arg == "methods"), None)
                        methods = [e.value for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, (ast.List, ast.Tuple)) else ["GET"]
                    out["route_handlers"] += [{"path": str(d.args[0].value), "method": m, "handler_function": node.name} for m in methods]
    if exported is not None:
        out["exports"] = [{"name": n, "kind": "variable"} for n in exported]
    else:
        kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
        out["exports"] = [{"name": n.name, "kind": kinds[type(n)]} for n in tree.body if type(n) in kinds and not n.name.startswith("_")]
    return out


def record(source: str, language: str, path: str = "") -> dict:
    if language == "python":
        return python_record(source)
    return READERS[language](source, path)


def extractions(files: DataFrame) -> DataFrame:
    """Extraction rows of files (path, language, text); languages without a reader give empty records."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, language, text in zip(pdf["path"], pdf["language"], pdf["text"], strict=True):
                row: dict = {k: [] for k in FIELDS} | {"path": path, "error": None}
                try:
                    if language in READERS or language == "python":
                        row |= record(text or "", language, path)
                except (SyntaxError, ValueError, RecursionError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"[:200]
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", *FIELDS, "error"])

    found = files.select("path", "language", "text").mapInPandas(run, SCHEMA)
    text, lang = F.col("text"), F.col("language")
    env = F.array().cast("array<string>")
    for name, patterns in signals.ENV_PATTERNS.items():
        env = F.when(lang == name, signals.env_vars(text, patterns)).otherwise(env)
    flat = files.select("path", "language", env.alias("env_vars"), line_count(text).alias("line_count"), signals.has_module_docstring(text, lang).alias("has_module_docstring"))
    marks = signals.line_signals(signals.lines(files.select("path", "text"))).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_number", "grp", "category", "line_content"))).alias("signal_lines"))
    return found.join(flat, "path").join(marks, "path", "left")
