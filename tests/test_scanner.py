"""Definitions of languages without a syntax tree: heads over several lines, brackets in strings and comments, kinds and places."""

import time

import pytest

from quarry.operators import scanner
from quarry.operators.extract import record

GO = '''// Package main serves.
package main

import "os"
import (
	f "fmt"
	// "no/such"
	"net/http"
)

const Limit = 3
const (
	A, B = iota, "x}"
	low
)

var Shared = 1

type (
	ID = string
	Store interface {
		Get(id ID) error
	}
)

// Server listens.
// On a port.
type Server struct {
	Host, name string `gorm:"column:host"`
	Opts struct {
		Deep int
	}
	*Base
}

func (s *Server) Start(
	host string,
	opts map[string]interface{},
) (interface{}, error) {
	text := "} func Fake() {"
	x = 5
	return "abc", nil
}

func Map[K comparable, V any](m map[K]V) []V { return nil }

func main() {
	http.HandleFunc("/h", handle)
	r.GET("/g", s.list)
}
'''


def names(rows):
    return [r["name"] for r in rows]


def test_go():
    r = record(GO, "go")
    assert [(i["module"], i["alias"]) for i in r["imports"]] == [("os", None), ("fmt", "f"), ("net/http", None)]
    assert [(c["name"], c["value"]) for c in r["constants"]] == [("Limit", "3"), ("A", "iota"), ("low", None)]
    assert [(t["name"], t["kind"]) for t in r["type_defs"]] == [("ID", "type_alias"), ("Store", "interface"), ("Server", "struct")]
    assert [(f["qualified_name"], f["parameters"], f["return_type"]) for f in r["functions"]] == [
        ("Server.Start", ["host string", "opts map[string]interface{}"], "(interface{}, error)"),
        ("Map", ["m map[K]V"], "[]V"),
        ("main", [], None),
    ]
    server = r["classes"][0]
    assert names(server["methods"]) == ["Start"] and server["docstring"] == "Server listens.\nOn a port."
    assert r["db_models"] == [{"name": "Server", "fields": ["Host", "name", "Opts"]}]
    assert [(e["name"], e["kind"]) for e in r["exports"]] == [("Limit", "variable"), ("A", "variable"), ("B", "variable"), ("Shared", "variable"), ("ID", "type"), ("Store", "type"), ("Server", "type"), ("Start", "function"), ("Map", "function")]
    assert [(x["path"], x["method"], x["handler_function"]) for x in r["route_handlers"]] == [("/h", "*", "handle"), ("/g", "GET", "")]


RUST = '''//! Docs.
use std::{io::{self, Read}, fmt, collections::HashMap as Map};
use crate::x::*;
pub const MAX: usize = 3;
static NAME: &str = "}";

/// A config.
#[derive(Debug, FromRow)]
pub struct Config<'a> {
    pub host: &'a str,
    #[serde(default)]
    port: u16,
}

pub struct Unit(u8, u8);
pub enum Kind { A, B }
type Alias = Vec<u8>;

pub trait Handler {
    fn handle(&self) -> String;
    fn twice(&self) -> String { format!("{{{}", 1) }
}

impl<'a> Config<'a> {
    pub async fn load(
        path: &str,
    ) -> Result<Self, Box<dyn Error>>
    where
        Self: Sized,
    {
        fn inner() {}
        let c = '}';
        Ok(todo!())
    }
}

impl<'a> Handler for Config<'a> {
    fn handle(&self) -> String { r#"} fn no() {"#.to_string() }
}

#[get("/items")]
pub fn list() -> u8 { 1 }

mod deep {
    pub fn below() {}
}
'''


def test_rust():
    r = record(RUST, "rust")
    assert [(f["qualified_name"], f["is_async"]) for f in r["functions"]] == [("Handler.twice", False), ("Config.load", True), ("Config.handle", False), ("list", False), ("below", False)]
    load = r["functions"][1]
    assert load["return_type"] == "Result<Self, Box<dyn Error>>" and load["parameters"] == ["path: &str"] and load["signature"].startswith("pub async fn load(")
    assert [(t["name"], t["kind"]) for t in r["type_defs"]] == [("Config", "struct"), ("Unit", "struct"), ("Kind", "enum"), ("Alias", "type_alias"), ("Handler", "interface")]
    config = r["classes"][0]
    assert names(config["methods"]) == ["load", "handle"] and config["docstring"] == "A config." and config["decorators"] == ["#[derive(Debug, FromRow)]"]
    assert r["db_models"] == [{"name": "Config", "fields": ["host", "port"]}]
    assert [(i["module"], i["names"], i["alias"], i["is_relative"]) for i in r["imports"]] == [("std", ["fmt"], None, False), ("std::io", ["self", "Read"], None, False), ("std::collections", ["HashMap"], "Map", False), ("crate::x", ["*"], None, True)]
    assert [(c["name"], c["value"]) for c in r["constants"]] == [("MAX", "3"), ("NAME", '"}"')]
    assert names(r["exports"]) == ["MAX", "Config", "Unit", "Kind", "Handler", "list", "below"]
    assert r["route_handlers"] == [{"path": "/items", "method": "GET", "handler_function": "list"}]


JAVA = '''package a.b;
import java.util.List;
import java.util.*;
import static java.lang.Math.max;

/** Serves users. */
@RestController
@RequestMapping("/api")
public class UserService extends Base<User> implements Closeable, Runnable {
    private static final String BRACE = "}";
    public static final int MAX = Math.max(1,
        2);
    private final Repo repo = new Repo("x") { void hidden() {} };
    @Autowired List<String> tags;

    public UserService(Repo repo) { this.repo = repo; }

    /** Lists. */
    @GetMapping(value = "/users")
    public <T extends Comparable<T>> Map<String, List<T>> list(
            @RequestParam("q") String q,
            int... rest) throws IOException, Other {
        if (q == null) { return null; }
        String s = "class Fake { void no() {}";
        return make(q);
    }

    void packagePrivate() { for (int i = 0; i < 3; i++) { run(); } }
    @GET @Path("/raw") abstract int raw();
    class Inner { void deep() {} }
}

@Entity
class Row { int id; String text; }
record Point(int x, int y) implements Shape { double length() { return 1; } }
interface Shape { double area(); default int n() { return 1; } }
enum Color { RED, GREEN; Color next() { return RED; } }
@interface Mark { String value() default "x"; }
'''


def test_java():
    r = record(JAVA, "java")
    assert [f["qualified_name"] for f in r["functions"]] == ["UserService.UserService", "UserService.list", "UserService.packagePrivate", "UserService.raw", "Point.length", "Shape.area", "Shape.n", "Color.next"]
    listed = r["functions"][1]
    assert listed["return_type"] == "Map<String, List<T>>" and listed["parameters"] == ['@RequestParam("q") String q', "int... rest"] and listed["docstring"] == "Lists."
    assert [(c["name"], c["bases"]) for c in r["classes"]] == [("UserService", ["Base<User>", "Closeable", "Runnable"]), ("Row", []), ("Point", ["Shape"]), ("Shape", []), ("Color", [])]
    assert r["classes"][0]["decorators"] == ["@RestController", '@RequestMapping("/api")'] and r["classes"][0]["docstring"] == "Serves users."
    assert [(c["name"], c["value"]) for c in r["constants"]] == [("BRACE", '"}"'), ("MAX", "Math.max(1, 2)")]
    assert [(t["name"], t["kind"]) for t in r["type_defs"]] == [("Shape", "interface"), ("Color", "enum"), ("Mark", "annotation")]
    assert [(i["module"], i["names"], i["alias"]) for i in r["imports"]] == [("java.util", ["List"], None), ("java.util", ["*"], None), ("java.lang.Math", ["max"], "max")]
    assert [(x["path"], x["method"], x["handler_function"]) for x in r["route_handlers"]] == [("/api/users", "GET", "list"), ("/api/raw", "GET", "raw")]
    assert r["db_models"] == [{"name": "Row", "fields": ["id", "text"]}] and r["exports"] == [{"name": "UserService", "kind": "class"}]


SCRIPT = '''import React, { useState as s, type Props } from "react";
import * as path from 'path';
import type { T } from "./types";
import "./side.css";
const { readFile, join: j } = require("fs");
const lodash = require("lodash");

export const MAX_SIZE = 10;
const COMPUTED = compute("}");
export type Pair<T> = { a: T; b: T };
export interface Shape extends Base { area(): number }
enum Color { Red, Green }

/** Adds. */
export async function add<T extends { x: number }>(
  a: number,
  b = ")",
): Promise<number> {
  const text = `} function no() {`;
  return a;
}

export const arrow = async (x: number, { y }: Props): Promise<void> => { run(x); };
const one = x => x + 1;
const old = function (q) { return q; };
const notAFunction = (1 + 2);

@Entity()
export class User extends Model<User> implements A, B {
  @Column({ type: "text" })
  name: string;
  private readonly id = make(1);

  constructor(private x: number) { super(); }

  /** Saves. */
  @Log("x")
  async save<T>(item: T, opts = { deep: true }): Promise<T> {
    if (item) { while (true) { call(item); } }
    return item;
  }
  static get total(): number { return 1; }
  handle = (e: Event): void => { this.save(e); };
}
abstract class Plain { abstract go(): void; run() {} }

export default Plain;
export { one as first, old };
export * from "./all";

app.get("/items", auth, list);
userRouter.post('/new', async (req) => { res.send("}"); });
const userSchema = new mongoose.Schema({ name: String, "age": { type: Number } });
const users = pgTable("users", { id: serial("id"), email: text("email") });
mongoose.model('Thing', userSchema);
const router2 = t.router({ hello: publicProcedure.input(z.string()).query(() => 1) });
const re = /[}/]{2}"/g;
function after() {}
'''


def test_typescript():
    r = record(SCRIPT, "typescript", "src/app/api/users/route.ts")
    assert names(r["functions"]) == ["add", "arrow", "one", "old", "after"]
    add, arrow = r["functions"][:2]
    assert (add["is_async"], add["parameters"], add["return_type"], add["docstring"]) == (True, ["a: number", 'b = ")"'], "Promise<number>", "Adds.")
    assert (arrow["is_async"], arrow["parameters"], arrow["return_type"]) == (True, ["x: number", "{ y }: Props"], "Promise<void>")
    user = r["classes"][0]
    assert names(r["classes"]) == ["User", "Plain"] and user["bases"] == ["Model<User>", "A", "B"]
    assert [(m["name"], m["is_async"], m["return_type"]) for m in user["methods"]] == [("constructor", False, None), ("save", True, "Promise<T>"), ("total", False, "number"), ("handle", False, "void")]
    assert user["methods"][1]["decorators"] == ['@Log("x")'] and user["methods"][1]["docstring"] == "Saves." and names(r["classes"][1]["methods"]) == ["go", "run"]
    assert [(i["module"], i["names"], i["alias"]) for i in r["imports"]] == [("fs", ["readFile", "join"], None), ("lodash", ["lodash"], "lodash"), ("react", ["React", "useState", "Props"], None), ("path", ["*"], "path"), ("./types", ["T"], None), ("./side.css", [], None)]
    assert [(c["name"], c["value"]) for c in r["constants"]] == [("MAX_SIZE", "10"), ("COMPUTED", None)]
    assert [(t["name"], t["kind"]) for t in r["type_defs"]] == [("Pair", "type_alias"), ("Shape", "interface"), ("Color", "enum")]
    assert [(e["name"], e["kind"]) for e in r["exports"]] == [("MAX_SIZE", "variable"), ("Pair", "type"), ("Shape", "type"), ("add", "function"), ("arrow", "variable"), ("User", "class"), ("Plain", "default"), ("one", "variable"), ("old", "variable")]
    assert [(x["path"], x["method"], x["handler_function"]) for x in r["route_handlers"]] == [("/items", "GET", "list"), ("/new", "POST", "<arrow>"), ("trpc.query", "QUERY", ""), ("/api/users", "*", "")]
    assert r["db_models"] == [{"name": "User", "fields": ["name", "id"]}, {"name": "Thing", "fields": []}, {"name": "userSchema", "fields": ["name", "age"]}, {"name": "users", "fields": ["id", "email"]}]


def test_next_routes_and_javascript():
    r = record("export async function GET(req) {}\nexport function POST() {}\ninterface X {}\n", "javascript", "app/api/users/route.js")
    assert [(x["path"], x["method"]) for x in r["route_handlers"]] == [("/api/users", "GET"), ("/api/users", "POST")] and r["type_defs"] == []
    r = record("module.exports = {};\n", "javascript", "pages/api/a/b.js")
    assert [(x["path"], x["method"]) for x in r["route_handlers"]] == [("/api/a/b", "*")]


@pytest.mark.parametrize("language", list(scanner.READERS))
def test_broken_and_long_sources(language):
    began = time.monotonic()
    for text in ("", "{", "}" * 50, '"', "/*", "func (", "class {", "@" * 300, "import {", "impl", "export default", "(" * 2000, "a<" * 2000, "fn f<" * 500, GO[:300], JAVA[:777], SCRIPT[:900], RUST[:500]):
        assert set(record(text, language)) == set(scanner.empty())
    body = {"go": "func f%d(a int) error {\n\treturn nil\n}\n", "rust": "pub fn f%d(a: u8) -> u8 { a }\n", "java": "class C%d { int f(int a) { return a; } }\n"}.get(language, "export function f%d(a) { return a; }\n")
    r = record("".join(body % k for k in range(1500)), language)
    assert len(r["functions"]) == 1500 and time.monotonic() - began < 30
