"""Queries that extract definitions from sources of each language, written around the names of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.extract import extractions
from quarry.plans.queries import query
from quarry.plans.views import view

#: One source for each language; @ stands for the number of a nation.  Brackets in strings and comments must count for nothing.
SOURCES = {
    "python": "from enum import Enum\nfrom typing import Protocol, TypeAlias\n\nPair@: TypeAlias = tuple\n\n\nclass Color@(Enum):\n    RED = 1\n\n\nclass Shape@(Protocol):\n    def area(self): ...\n",
    "go": """// Package n@ serves.
package n@

import (
\tf "fmt"
\t// "no/such"
\t"net/http"
)

const Limit@ = @

type Store@ interface {
\tGet(id string) error
}

// Server@ listens.
type Server@ struct {
\tHost string `db:"host"`
\tport int
}

func (s *Server@) Start(
\thost string,
\topts map[string]interface{},
) (interface{}, error) {
\ttext := "} func Fake() {"
\treturn text, nil
}

func run@() { http.HandleFunc("/go/@", handle@) }
""",
    "rust": """//! Docs.
use std::collections::{HashMap, HashSet as Set};
pub const MAX_@: usize = @;

/// A config.
#[derive(Debug, FromRow)]
pub struct Config@ {
    pub host: String,
    port: u16,
}
pub trait Handler@ { fn handle(&self); }
impl Config@ {
    pub async fn load(
        path: &str,
    ) -> Result<Self, Error> {
        let c = '}';
        todo!()
    }
}
#[get("/rust/@")]
fn list@() -> u8 { 1 }
""",
    "java": """package a.b;
import java.util.List;

/** Serves. */
@@RestController
@@RequestMapping("/api@")
public class Service@ extends Base implements Closeable {
    private static final String BRACE = "}";
    @@GetMapping("/users")
    public <T> Map<String, List<T>> list(
            String q,
            int... rest) throws IOException {
        String s = "class Fake { void no() {}";
        return make(q);
    }
    void local@() { for (int i = 0; i < 3; i++) { run(); } }
}
@@Entity class Row@ { int id; String text; }
interface Shape@ { double area(); }
""",
    "typescript": """import React, { useState as s } from "react";
import * as path from './path';
export const MAX_@ = @;
export interface Shape@ { area(): number }
/** Adds. */
export async function add@<T extends { x: number }>(
  a: number,
  b = ")",
): Promise<number> {
  const text = `} function no() {`;
  return a;
}
const one@ = (x: number) => x + 1;
@@Entity()
export class User@ extends Model<User> implements A {
  name: string;
  async save(item: T): Promise<T> { if (item) { call(item); } return item; }
  handle = (e: Event): void => { this.save(e); };
}
app.get("/ts/@", auth, list@);
""",
}


def _sources(s, d) -> DataFrame:
    p = view(s, d, "v_place").select("nk")
    out = None
    for language, source in SOURCES.items():
        parts = [x for piece in source.replace("@@", "\0").split("@") for x in (F.lit(piece.replace("\0", "@")), F.col("nk").cast("string"))][:-1]
        rows = p.select(F.concat(F.lit(f"{language}/"), F.col("nk").cast("string")).alias("path"), F.lit(language).alias("language"), F.concat(*parts).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _listed(column: str, line) -> Column:
    return F.array_join(F.transform(column, line), "; ").alias(column)


def _sql(expected: dict[str, str]) -> str:
    """The expected rows, from the same numbers: @ stands for the number of a nation."""
    rows = (f"SELECT '{language}/' || nk AS path, " + ", ".join(f"'{text.replace(chr(39), chr(39) * 2).replace('@', chr(39) + ' || nk || ' + chr(39))}' AS {name}" for name, text in zip(expected["columns"].split(), texts, strict=True)) + " FROM v_place" for language, texts in expected.items() if language != "columns")
    return " UNION ALL ".join(rows)


def _class(c: Column) -> Column:
    return F.concat(c["name"], F.lit("("), F.array_join(c["bases"], ","), F.lit("):"), F.array_join(F.transform(c["methods"], lambda m: m["name"]), ","))


def _function(f: Column) -> Column:
    shown = F.concat(f["qualified_name"], F.lit("("), F.array_join(f["parameters"], ","), F.lit(")"), F.coalesce(F.concat(F.lit(" "), f["return_type"]), F.lit("")))
    return F.concat(shown, F.lit(" "), f["line_start"].cast("string"), F.lit("-"), f["line_end"].cast("string"))


@query("x1_x2_definitions", _sql({
    "columns": "functions classes",
    "python": ["", "Color@(Enum):; Shape@(Protocol):area"],
    "go": ["Server@.Start(host string,opts map[string]interface{}) (interface{}, error) 22-28; run@() 30-30", "Server@():Start"],
    "rust": ["Config@.load(path: &str) Result<Self, Error> 13-18; list@() u8 21-21", "Config@():load"],
    "java": ["Service@.list(String q,int... rest) Map<String, List<T>> 10-15; Service@.local@() void 16-16; Shape@.area() double 19-19", "Service@(Base,Closeable):list,local@; Row@():; Shape@():area"],
    "typescript": ['add@(a: number,b = ")") Promise<number> 6-12; one@(x: number) 13-13', "User@(Model<User>,A):save,handle"],
}), "v_place")
def _(s, d):
    return extractions(_sources(s, d)).select("path", _listed("functions", _function), _listed("classes", _class))


@query("x3_x4_imports_types", _sql({
    "columns": "imports type_defs",
    "python": ["enum:Enum; typing:Protocol,TypeAlias", "Pair@ type_alias; Color@ enum; Shape@ protocol"],
    "go": ["fmt: f; net/http:", "Store@ interface; Server@ struct"],
    "rust": ["std::collections:HashMap,HashSet as Set", "Config@ struct; Handler@ interface"],
    "java": ["java.util:List", "Shape@ interface"],
    "typescript": ["react:React,useState; ./path:* path", "Shape@ interface"],
}), "v_place")
def _(s, d):
    one = lambda i: F.concat(i["module"], F.lit(":"), F.array_join(i["names"], ","), F.coalesce(F.concat(F.lit(" "), i["alias"]), F.lit("")))
    kind = lambda t: F.concat(t["name"], F.lit(" "), t["kind"])
    return extractions(_sources(s, d)).select("path", _listed("imports", one), _listed("type_defs", kind))


@query("x5_x6_exports_of_languages", _sql({
    "columns": "exports constants",
    "python": ["Color@ class; Shape@ class", ""],
    "go": ["Limit@ variable; Store@ type; Server@ type; Start function", "Limit@=@"],
    "rust": ["MAX_@ variable; Config@ class; Handler@ type", "MAX_@=@"],
    "java": ["Service@ class", 'BRACE="}"'],
    "typescript": ["MAX_@ variable; Shape@ type; add@ function; User@ class", "MAX_@=@"],
}), "v_place")
def _(s, d):
    export = lambda e: F.concat(e["name"], F.lit(" "), e["kind"])
    constant = lambda c: F.concat(c["name"], F.lit("="), c["value"])
    return extractions(_sources(s, d)).select("path", _listed("exports", export), _listed("constants", constant))


@query("x7_x8_routes_of_languages", _sql({
    "columns": "route_handlers db_models",
    "python": ["", ""],
    "go": ["/go/@ * handle@", "Server@:Host+port"],
    "rust": ["/rust/@ GET list@", "Config@:host+port"],
    "java": ["/api@/users GET list", "Row@:id+text"],
    "typescript": ["/ts/@ GET list@", "User@:name"],
}), "v_place")
def _(s, d):
    route = lambda r: F.concat_ws(" ", r["path"], r["method"], r["handler_function"])
    model = lambda m: F.concat(m["name"], F.lit(":"), F.array_join(m["fields"], "+"))
    return extractions(_sources(s, d)).select("path", _listed("route_handlers", route), _listed("db_models", model))
