"""Definitions in Go, Rust, Java, TypeScript and JavaScript sources, without a grammar.

A source is first masked: comments become blanks and the insides of strings too,
so that brackets and words in them count for nothing; all places stay.  Brackets
are paired once.  Heads of definitions are then patterns over the masked text,
over any number of lines, and a definition counts only at the bracket depth where
its language allows one.  What is reported is cut from the source itself.
Not read: macros, preprocessors, and definitions inside functions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

# Fixed values.
HTTP = ["get", "post", "put", "delete", "patch", "head", "options"]
ROUTERS = ["app", "router", "server", "hono"]
DB_DERIVES = ["FromRow", "Queryable", "Insertable", "Selectable", "sqlx::FromRow", "diesel::Queryable", "diesel::Insertable", "diesel::Selectable"]
DB_TAGS = ["gorm:", "db:", "bson:"]
SPRING = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
TABLES = ["pgTable", "mysqlTable", "sqliteTable"]

_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
#: Comments and strings of each language; the first alternative that fits at a place wins.
OPAQUE = {
    "go": rf'{_COMMENT}|`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "rust": rf'{_COMMENT}|\bb?r(?P<raw>#*)".*?"(?P=raw)|"(?:\\.|[^"\\])*"|\'(?:\\[^\n]+?|[^\'\\\n])\'',
    "java": rf'{_COMMENT}|""".*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "typescript": rf'{_COMMENT}|`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|(?<=[=(,:;!&|?{{}}\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/',
}
OPAQUE["javascript"] = OPAQUE["typescript"]
_OPAQUE = {k: re.compile(v, re.S) for k, v in OPAQUE.items()}
_BLANK = re.compile(r"[^\n]")
_CLOSE = {")": "(", "]": "[", "}": "{"}


class Source:
    """A text, its masked form, and where its brackets end."""

    def __init__(self, text: str, language: str):
        self.text = text
        self.comments: list[tuple[int, int]] = []
        parts, at = [], 0
        for m in _OPAQUE[language].finditer(text):
            a, b = m.span()
            comment = text.startswith(("//", "/*"), a)
            if comment:
                self.comments.append((a, b))
            parts += [text[at:a], _BLANK.sub(" ", m[0]) if comment else m[0][0] + _BLANK.sub(" ", m[0][1:-1]) + m[0][-1]]
            at = b
        self.code = "".join([*parts, text[at:]])
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.partner: dict[int, int] = {}
        self.opener: dict[int, int] = {}
        self.opened: list[int] = []  # places where the depth in braces changes, and the depth from there on
        self.depths: list[int] = []
        stack: list[int] = []
        depth = 0
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c, k = m[0], m.start()
            if c in "([{":
                stack.append(k)
            else:
                while stack and self.code[stack[-1]] != _CLOSE[c]:
                    stack.pop()
                if stack:
                    self.opener[k] = stack[-1]
                    self.partner[stack.pop()] = k
            if c in "{}":
                depth = max(0, depth + (1 if c == "{" else -1))
                self.opened.append(k + (c == "{"))
                self.depths.append(depth)

    def depth(self, at: int) -> int:
        k = bisect_right(self.opened, at) - 1
        return self.depths[k] if k >= 0 else 0

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def cut(self, a: int, b: int) -> str:
        return " ".join(self.text[a:b].split())

    def close(self, at: int) -> int:
        """Place of the bracket that ends the one at ``at``; the end of the text where none does."""
        return self.partner.get(at, len(self.code))

    def skip(self, at: int) -> int:
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return at

    def generics(self, at: int) -> int:
        """Past a list in angle brackets, if one begins here."""
        start = self.skip(at)
        if not self.code.startswith("<", start):
            return at
        level, k = 0, start
        while k < len(self.code):
            c = self.code[k]
            level += (c == "<") - (c == ">" and self.code[k - 1] not in "-=")
            if level == 0:
                return k + 1
            if c in ";)]}":
                return at
            k = self.close(k) + 1 if c in "([{" else k + 1
        return at

    def body(self, at: int, blocks: str = "") -> tuple[int | None, int]:
        """(place of the brace that begins the body after a head, or None; end of the head).  Braces after a word of ``blocks`` belong to types."""
        k = at
        while k < len(self.code):
            c = self.code[k]
            if c == "{":
                if blocks and re.search(rf"\b(?:{blocks})\s*$", self.code[at:k]):
                    k = self.close(k) + 1
                    continue
                return k, k
            if c in "([":
                k = self.close(k)
            elif c in ";}":
                return None, k
            k += 1
        return None, len(self.code)

    def split(self, a: int, b: int) -> list[str]:
        """Parts of [a, b) between commas outside all brackets."""
        out, start, k = [], a, a
        angle = 0
        while k < b:
            c = self.code[k]
            if c in "([{":
                k = min(self.close(k), b - 1)
            elif c in "<>" and self.code[k - 1] not in "-=":
                angle = max(0, angle + (1 if c == "<" else -1))
            elif c == "," and not angle:
                out.append(self.cut(start, k))
                start = k + 1
            k += 1
        return [p for p in [*out, self.cut(start, b)] if p]

    def doc(self, at: int) -> str | None:
        """The comments that end right above ``at``, without their marks."""
        k = bisect_right(self.comments, (at, at)) - 1
        found: list[str] = []
        while k >= 0 and self.comments[k][1] <= at and self.code[self.comments[k][1] : at].strip() == "" and self.text.count("\n", self.comments[k][1], at) <= 1:
            a, b = self.comments[k]
            if self.text[self.lines[self.line(a) - 1] : a].strip():
                break  # a comment behind code
            found.append(self.text[a:b])
            at, k = self.lines[self.line(a) - 1], k - 1
        plain = [re.sub(r"^\s*(?:/\*+|\*+/|//[/!]?|\*)?\s?|\s*\*+/\s*$", "", x) for block in reversed(found) for x in block.split("\n")]
        return "\n".join(plain).strip() or None

    def marks(self, at: int, pattern: str) -> tuple[list[str], int]:
        """Attributes or annotations right before ``at``, in order, and where they begin."""
        out: list[str] = []
        while True:
            end = at
            while end and self.code[end - 1].isspace():
                end -= 1
            opener = self.opener.get(end - 1)
            base = opener if opener is not None else end
            found = re.search(pattern + r"$", self.code[max(0, base - 200) : base]) if opener is not None or "@" in pattern else None
            if found is None:
                return out[::-1], at
            at = base - len(found[0])
            out.append(self.cut(at, end))

    def heads(self, pattern: re.Pattern, a: int = 0, b: int | None = None, depth: int | None = 0) -> Iterator[re.Match]:
        for m in pattern.finditer(self.code, a, len(self.code) if b is None else b):
            if depth is None or self.depth(m.start("name") if "name" in pattern.groupindex and m["name"] else m.start()) == depth:
                yield m


def empty() -> dict:
    return {k: [] for k in ("functions", "classes", "imports", "type_defs", "exports", "constants", "route_handlers", "db_models")}


def _function(s: Source, start: int, name: str, owner: str | None, head_end: int, end: int, params: list[str], returns: str | None, decorators: list[str], doc_at: int, is_async: bool = False) -> dict:
    return {"name": name, "qualified_name": f"{owner}.{name}" if owner else name, "signature": s.cut(start, head_end), "line_start": s.line(start), "line_end": s.line(max(start, min(end, len(s.text)) - 1)), "docstring": s.doc(doc_at), "decorators": decorators, "is_async": is_async, "parameters": params, "return_type": returns or None}


def _type(s: Source, name: str, kind: str, start: int, end: int) -> dict:
    return {"name": name, "kind": kind, "line_start": s.line(start), "line_end": s.line(max(start, end - 1))}


def _class(s: Source, name: str, start: int, end: int, bases: list[str], decorators: list[str], doc_at: int, methods: list[dict]) -> dict:
    return {"name": name, "line_start": s.line(start), "line_end": s.line(max(start, end - 1)), "bases": bases, "docstring": s.doc(doc_at), "decorators": decorators, "methods": methods}


# Go

_GO_FUNC = re.compile(r"^func\s+(?:\((?P<receiver>[^()]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?(?=\()", re.M)
_GO_DECL = re.compile(r"^(?P<word>import|const|var|type)\b[ \t]*(?P<group>\()?", re.M)
_GO_ROUTES = [re.compile(r'\w+\.Handle(?:Func)?\s*\(\s*"(?P<path>[^"]+)"'), re.compile(r'\w+\.(?P<method>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Get|Post|Put|Delete|Patch|Head|Options)\s*\(\s*"(?P<path>[^"]+)"')]


def _go_specs(s: Source, m: re.Match) -> Iterator[tuple[int, int]]:
    """Places of the specs of a declaration: one, or one for each line that begins at the group's own depth."""
    if not m["group"]:
        at = end = m.end()
        while end < len(s.code) and s.code[end] != "\n":
            end = s.close(end) + 1 if s.code[end] in "([{" else end + 1
        yield at, end
        return
    at, stop = m.end(), s.close(m.start("group"))
    while at < stop:
        end = at
        while end < stop and s.code[end] not in "\n;":
            end = s.close(end) + 1 if s.code[end] in "([{" else end + 1
        if s.code[at:end].strip():
            yield s.skip(at), end
        at = end + 1


def go(text: str, path: str = "") -> dict:
    s, out = Source(text, "go"), empty()
    places: list[tuple[int, dict]] = []
    structs: dict[str, dict] = {}
    for m in s.heads(_GO_DECL):
        for a, b in _go_specs(s, m):
            spec = s.code[a:b]
            if m["word"] == "import":
                if found := re.search(r'(?:([\w.]+)\s+)?["`]([^"`]+)["`]', s.text[a:b]):
                    if s.code[a + found.start(2) - 1] in '"`':
                        out["imports"].append({"module": found[2], "names": [], "is_relative": found[2].startswith("."), "alias": found[1]})
            elif m["word"] == "type":
                if not (found := re.match(r"(\w+)\s*(?:\[[^\]]*\]\s*)?(=)?\s*(struct|interface)?", spec)):
                    continue
                name, kind = found[1], found[3] or "type_alias"
                out["type_defs"].append(_type(s, name, kind, a, b))
                if name[:1].isupper():
                    places.append((a, {"name": name, "kind": "type"}))
                if kind == "struct":
                    start = m.start() if not m["group"] else a
                    structs[name] = _class(s, name, start, b, [], [], start, [])
                    brace = s.code.find("{", a, b)
                    fields, tags = [], False
                    for line in re.finditer(r"[^\n;]+", s.code[brace + 1 : s.close(brace)] if brace >= 0 else ""):
                        at = brace + 1 + line.start()
                        if s.depth(at) != s.depth(brace) + 1 or not line[0].strip():
                            continue
                        lead = re.match(r"\s*((?:\w+\s*,\s*)*\w+)\s+[^\s`\"]", line[0])
                        fields += [x.strip() for x in lead[1].split(",")] if lead else []
                        tags = tags or any(t in s.text[at : at + len(line[0])] for t in DB_TAGS) and ("`" in line[0] or '"' in line[0])
                    if tags:
                        out["db_models"].append({"name": name, "fields": fields})
            else:
                names, _, value = spec.partition("=")
                lead = re.match(r"\s*((?:\w+\s*,\s*)*\w+)", names)
                named = [x.strip() for x in lead[1].split(",")] if lead else []
                places += [(a, {"name": x, "kind": "variable"}) for x in named if x[:1].isupper()]
                if m["word"] == "const" and named:
                    at = a + len(names) + 1
                    values = s.split(at, b) if value else []
                    out["constants"].append({"name": named[0], "value": values[0][:200] if values else None, "line": s.line(a)})
    out["classes"] = list(structs.values())
    for m in s.heads(_GO_FUNC):
        end_of_params = s.close(m.end())
        brace, head_end = s.body(end_of_params + 1, "interface|struct")
        if "\n" in s.code[end_of_params + 1 : head_end] and brace is not None and s.code[end_of_params + 1 : s.code.find("\n", end_of_params)].strip() == "":
            brace, head_end = None, end_of_params + 1  # declared without a body
        returns = s.cut(end_of_params + 1, head_end)
        owner = re.findall(r"\w+", re.sub(r"\[.*", "", m["receiver"]))[-1:] if m["receiver"] else []
        end = s.close(brace) + 1 if brace is not None else head_end
        f = _function(s, m.start(), m["name"], owner[0] if owner else None, head_end, end, s.split(m.end() + 1, end_of_params), returns, [], m.start())
        out["functions"].append(f)
        if owner and owner[0] in structs:
            structs[owner[0]]["methods"].append(f)
        if m["name"][:1].isupper():
            places.append((m.start(), {"name": m["name"], "kind": "function"}))
    out["exports"] = [e for _, e in sorted(places, key=lambda p: p[0])]
    seen = set()
    for line in re.finditer(r"[^\n]+", text):
        for pattern in _GO_ROUTES:
            if (m := pattern.search(line[0])) and s.code[line.start() + m.start("path") - 1] == '"':
                method = (m.groupdict().get("method") or "*").upper()
                if (m["path"], method) not in seen:
                    seen.add((m["path"], method))
                    handler = re.search(r",\s*(\w+)\s*[,)]", line[0][m.start() :])
                    out["route_handlers"].append({"path": m["path"], "method": method, "handler_function": handler[1] if handler else ""})
    return out


# Rust

_RS_VISIBLE = r"(?P<pub>pub(?:\s*\([^)]*\))?\s+)?"
_RS_FN = re.compile(rf"{_RS_VISIBLE}(?P<how>(?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*)\bfn\s+(?P<name>\w+)")
_RS_TYPE = re.compile(rf"{_RS_VISIBLE}(?:unsafe\s+)?\b(?P<kind>struct|enum|trait|type|union)\s+(?P<name>\w+)")
_RS_IMPL = re.compile(r"\bimpl\b(?=[\s<])")
_RS_CONST = re.compile(rf"{_RS_VISIBLE}\b(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:(?!:)")
_RS_USE = re.compile(r"^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?use\s+(?P<name>[^;]+);", re.M)
_RS_MOD = re.compile(r"\bmod\s+\w+\s*(?=\{)")
_RS_ROUTE = re.compile(r'#\[(get|post|put|delete|patch|head|options)\s*\(\s*"([^"]+)"', re.I)
_RS_KIND = {"struct": "struct", "union": "struct", "enum": "enum", "trait": "interface", "type": "type_alias"}


def _rust_use(text: str, prefix: str = "") -> list[dict]:
    """Imports of a use tree; a list of names below one path is one import."""
    text = " ".join(text.split())
    relative = lambda p: p.split("::")[0] in ("crate", "self", "super")
    if m := re.fullmatch(r"(.*?)(?:::)?\s*\{(.*)\}", text):
        base = "::".join(x for x in (prefix, m[1].strip()) if x)
        level, parts, start = 0, [], 0
        for k, c in enumerate(m[2] + ","):
            level += (c == "{") - (c == "}")
            if c == "," and level == 0:
                parts.append((m[2] + ",")[start:k].strip())
                start = k + 1
        flat = [p for p in parts if p and "{" not in p and "::" not in p]
        out = [{"module": base, "names": flat, "is_relative": relative(base), "alias": None}] if flat else []
        for p in parts:
            if "{" in p or "::" in p:
                out += _rust_use(p, base)
        return out
    full, _, alias = text.partition(" as ")
    full = "::".join(x for x in (prefix, full.strip()) if x)
    module, _, name = full.rpartition("::")
    return [{"module": module or full, "names": [name] if module else [], "is_relative": relative(full), "alias": alias.strip() or None}]


def rust(text: str, path: str = "") -> dict:
    s, out = Source(text, "rust"), empty()
    places: list[tuple[int, dict]] = []
    classes: dict[str, dict] = {}
    spans: list[tuple[int, int, str]] = []  # bodies of impl blocks and traits, and their owner
    inside: list[tuple[int, int]] = [(m.end(), s.close(m.end())) for m in _RS_MOD.finditer(s.code)]

    def free(at: int) -> bool:
        """At the top of the file or of a module."""
        return s.depth(at) == sum(a < at < z for a, z in inside)

    for m in _RS_IMPL.finditer(s.code):
        if not free(m.start()):
            continue
        at = s.generics(m.end())
        brace, _ = s.body(at)
        if brace is None:
            continue
        head = re.split(r"\bwhere\b", s.code[at:brace])[0]
        target = re.split(r"\bfor\b(?!\s*<)", head)[-1]
        owner = re.search(r"([A-Za-z_]\w*)\s*(?:<.*)?$", target.strip(), re.S)
        spans.append((brace, s.close(brace), owner[1] if owner else ""))
    for m in _RS_TYPE.finditer(s.code):
        if not free(m.start("name")):
            continue
        marks, start = s.marks(m.start(), "#!?")
        brace, head_end = s.body(m.end())
        end = s.close(brace) + 1 if brace is not None else head_end + 1
        out["type_defs"].append(_type(s, m["name"], _RS_KIND[m["kind"]], m.start(), end))
        if m["pub"]:
            places.append((m.start(), {"name": m["name"], "kind": "class" if m["kind"] in ("struct", "union") else "type"}))
        if m["kind"] == "trait" and brace is not None:
            spans.append((brace, s.close(brace), m["name"]))
        if m["kind"] in ("struct", "union"):
            classes[m["name"]] = _class(s, m["name"], m.start(), end, [], marks, start, [])
            derived = {x.strip() for mark in marks for found in re.findall(r"derive\s*\(([^)]*)\)", mark) for x in found.split(",")}
            if derived & set(DB_DERIVES):
                fields = [re.match(r"(?:#\s*\[[^\]]*\]\s*)*(?:pub(?:\s*\([^)]*\))?\s+)?(\w+)\s*:", x) for x in s.split(brace + 1, end - 1)] if brace is not None else []
                out["db_models"].append({"name": m["name"], "fields": [f[1] for f in fields if f]})
    out["classes"] = list(classes.values())
    for m in _RS_FN.finditer(s.code):
        own = [x for x in spans if x[0] < m.start() < x[1]]
        holder = max(own, default=None)
        if not (free(m.start("name")) or (holder and s.depth(m.start("name")) == s.depth(holder[0]) + 1)):
            continue
        opener = s.skip(s.generics(m.end()))
        if not s.code.startswith("(", opener):
            continue
        closer = s.close(opener)
        brace, head_end = s.body(closer + 1)
        if brace is None:
            continue  # a trait's signature
        returns = re.match(r"\s*->\s*(.*?)\s*(?:\bwhere\b.*)?$", s.code[closer + 1 : head_end], re.S)
        marks, start = s.marks(m.start(), "#!?")
        f = _function(s, m.start(), m["name"], holder[2] if holder else None, head_end, s.close(brace) + 1, s.split(opener + 1, closer), s.cut(closer + 1 + returns.start(1), closer + 1 + returns.end(1)) if returns else None, marks, start, "async" in m["how"])
        out["functions"].append(f)
        if holder and holder[2] in classes:
            classes[holder[2]]["methods"].append(f)
        elif not holder and m["pub"]:
            places.append((m.start(), {"name": m["name"], "kind": "function"}))
        for mark in marks:
            if found := _RS_ROUTE.search(mark):
                out["route_handlers"].append({"path": found[2], "method": found[1].upper(), "handler_function": m["name"]})
    for m in _RS_CONST.finditer(s.code):
        if not free(m.start("name")):
            continue
        end = s.code.find(";", m.end())
        equals = s.code.find("=", m.end(), end)
        out["constants"].append({"name": m["name"], "value": s.cut(equals + 1, end)[:200] if equals >= 0 else None, "line": s.line(m.start())})
        if m["pub"]:
            places.append((m.start(), {"name": m["name"], "kind": "variable"}))
    for m in s.heads(_RS_USE, depth=None):
        if free(m.start("name")):
            out["imports"] += _rust_use(m["name"])
    out["exports"] = [e for _, e in sorted(places, key=lambda p: p[0])]
    return out


# Java

_J_MODS = r"(?P<mods>(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp|default|native|synchronized|transient|volatile)\s+)*)"
_J_TYPE = re.compile(rf"{_J_MODS}(?P<kind>@interface|\b(?:class|interface|enum|record))\s+(?P<name>\w+)")
_J_METHOD = re.compile(rf"(?<![\w.@$]){_J_MODS}(?P<generic><[^(){{}};=]*>\s*)?(?P<returns>(?:[\w.$]+(?:\s*<[^(){{}};=]*>)?(?:\s*\[\s*\])*)\s+)?(?P<name>\w+)\s*(?=\()")
_J_FIELD = re.compile(rf"(?<![\w.@$]){_J_MODS}(?P<type>[\w.$]+(?:\s*<[^(){{}};=]*>)?(?:\s*\[\s*\])*)\s+(?P<name>\w+)\s*(?=[=;,])")
_J_IMPORT = re.compile(r"^[ \t]*import\s+(?P<static>static\s+)?(?P<name>[\w.]+?)(?P<all>\.\*)?\s*;", re.M)
_J_WORDS = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "try", "do", "synchronized", "super", "this", "assert", "case", "yield", "package", "import", "class", "interface", "enum", "record", "extends", "implements"}
_J_SPRING = re.compile(r'@(?P<mark>(?:Get|Post|Put|Delete|Patch|Request)Mapping)\b(?:\s*\((?P<args>[^)]*)\))?')
_J_STRING = re.compile(r'"([^"]*)"')


def _java_mapping(args: str | None) -> tuple[str, str | None]:
    """Path and method that an annotation's arguments name."""
    args = args or ""
    named = re.search(r'\b(?:value|path)\s*=\s*\{?\s*"([^"]*)"', args) or re.match(r'\s*\{?\s*"([^"]*)"', args)
    method = re.search(r"RequestMethod\.(\w+)", args)
    return named[1] if named else "", method[1].upper() if method else None


def _java_routes(marks: list[str], prefix: str, handler: str) -> list[dict]:
    out = []
    text = " ".join(marks)
    for m in _J_SPRING.finditer(text):
        path, method = _java_mapping(m["args"])
        out.append({"path": prefix + path, "method": SPRING.get(m["mark"], method or "*"), "handler_function": handler})
    at = re.search(r'@Path\s*\(\s*"([^"]*)"', text)
    for m in re.finditer(r"@(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b", text):
        out.append({"path": prefix + (at[1] if at else ""), "method": m[1], "handler_function": handler})
    return out


def java(text: str, path: str = "") -> dict:
    s, out = Source(text, "java"), empty()
    for m in s.heads(_J_IMPORT):
        module, _, name = m["name"].rpartition(".")
        if m["all"]:
            module, names = m["name"], ["*"]
        else:
            module, names = (module, [name]) if module else (m["name"], [])
        out["imports"].append({"module": module, "names": names, "is_relative": False, "alias": names[0] if m["static"] and names and names[0] != "*" else None})
    for m in _J_TYPE.finditer(s.code):
        if s.depth(m.start("name")) != 0:
            continue
        marks, start = s.marks(m.start(), r"@[\w.]+\s*")
        after = s.skip(s.generics(m.end()))
        parts = s.split(after + 1, s.close(after)) if m["kind"] == "record" and s.code.startswith("(", after) else []
        brace, _ = s.body(s.close(after) + 1 if parts or s.code.startswith("(", after) else after)
        if brace is None:
            continue
        end, depth = s.close(brace), 1
        head = s.code[m.end() : brace]
        bases = []
        for found in re.finditer(r"\b(?:extends|implements)\b(.*?)(?=\bextends\b|\bimplements\b|\bpermits\b|$)", head, re.S):
            bases += s.split(m.end() + found.start(1), m.end() + found.end(1))
        kind, name = m["kind"], m["name"]
        if kind in ("interface", "enum", "@interface"):
            out["type_defs"].append(_type(s, name, {"@interface": "annotation"}.get(kind, kind), m.start(), end + 1))
        if "public" in m["mods"]:
            out["exports"].append({"name": name, "kind": "class" if kind in ("class", "record") else "type"})
        methods, fields = [], [re.split(r"\s+", p)[-1] for p in parts]
        prefix = ""
        for mark in marks:
            if found := re.search(r'@(?:RequestMapping|Path)\s*\((?P<args>[^)]*)\)', mark):
                prefix = _java_mapping(found["args"])[0]
        for f in _J_METHOD.finditer(s.code, brace + 1, end):
            returns = (f["returns"] or "").strip()
            if f["generic"] and not returns:  # the pattern takes both for one
                returns = s.cut(s.generics(f.start("generic")), f.start("name"))
            if s.depth(f.start("name")) != depth or f["name"] in _J_WORDS or returns.split("<")[0] in _J_WORDS or (not returns and f["name"] != name) or kind == "@interface":
                continue
            opener = f.end()
            closer = s.close(opener)
            inner, head_end = s.body(closer + 1)
            before = s.code[brace + 1 : f.start()].rstrip()[-1:]
            if re.match(r"\s*[^\s{;td]", s.code[closer + 1 : head_end + 1]) or before in ("=", ".", "(", ","):
                continue
            own, first = s.marks(f.start(), r"@[\w.]+\s*")
            record = _function(s, f.start() if f["mods"] or f["generic"] or f["returns"] else f.start("name"), f["name"], name, head_end, s.close(inner) + 1 if inner is not None else head_end + 1, s.split(opener + 1, closer), returns, own, first)
            methods.append(record)
            out["route_handlers"] += _java_routes(own, prefix, f["name"])
        for f in _J_FIELD.finditer(s.code, brace + 1, end):
            if s.depth(f.start("name")) != depth or f["type"].split("<")[0] in _J_WORDS or s.code[brace + 1 : f.start()].rstrip()[-1:] not in ("", ";", "}", ")", "{") and not re.search(r"@[\w.]+$", s.code[brace + 1 : f.start()].rstrip()[-80:]):
                continue
            fields.append(f["name"])
            mods = f["mods"].split()
            if "static" in mods and "final" in mods:
                stop = s.body(f.end())[1]
                at = s.code.find("=", f.end(), s.code.find(";", f.end()) + 1)
                stop = s.code.find(";", f.end()) if at < 0 else _statement_end(s, at)
                out["constants"].append({"name": f["name"], "value": s.cut(at + 1, stop)[:200] if at >= 0 else None, "line": s.line(f.start())})
        out["functions"] += methods
        if kind != "@interface":
            out["classes"].append(_class(s, name, m.start(), end + 1, bases, marks, start, methods))
        if kind in ("class", "record") and any(re.match(r"@(?:[\w.]+\.)?(?:Entity|Table)\b", x) for x in marks):
            out["db_models"].append({"name": name, "fields": fields})
    return out


def _statement_end(s: Source, at: int) -> int:
    """Place of the semicolon or line end that ends a statement."""
    k = at
    while k < len(s.code):
        c = s.code[k]
        if c in "([{":
            k = s.close(k)
        elif c in ";)}":
            return k
        elif c == "\n" and s.code[at + 1 : k].strip() and not re.search(r"[=+\-*/&|?:,.<>(]\s*$", s.code[at + 1 : k]) and not re.match(r"\s*[.?:+\-*/&|]", s.code[k:]):
            return k
        k += 1
    return len(s.code)


# TypeScript and JavaScript

_T_START = r"(?:^|(?<=[;{}]))[ \t]*"
_T_EXPORT = r"(?P<export>export\s+(?P<default>default\s+)?)?(?:declare\s+)?"
_T_FUNC = re.compile(rf"{_T_START}{_T_EXPORT}(?P<async>async\s+)?function\b\s*\*?\s*(?P<name>[\w$]+)?", re.M)
_T_VAR = re.compile(rf"{_T_START}{_T_EXPORT}(?P<word>const|let|var)\s+(?P<name>[\w$]+|\{{[^}}]*\}}|\[[^\]]*\])", re.M)
_T_CLASS = re.compile(rf"{_T_START}(?:@[\w.]+(?:\([^)]*\))?\s*)*{_T_EXPORT}(?P<abstract>abstract\s+)?class\b(?:\s+(?!extends\b|implements\b)(?P<name>[\w$]+))?", re.M)
_T_TYPE = re.compile(rf"{_T_START}{_T_EXPORT}(?:const\s+)?(?P<kind>interface|type|enum)\s+(?P<name>[\w$]+)(?=\s*[<={{]|\s+extends\b)", re.M)
_T_IMPORT = re.compile(rf"{_T_START}import\b(?!\s*\()(?P<clause>[^;'\"]*?)(?=['\"])", re.M)
_T_LIST = re.compile(rf"{_T_START}export\s+(?:type\s+)?\{{(?P<names>[^}}]*)\}}", re.M)
_T_DEFAULT = re.compile(rf"{_T_START}export\s+default\s+(?!async\s+function|function|class\b|abstract\b|interface\b)(?P<name>[\w$]+)?", re.M)
_T_METHOD = re.compile(r"(?P<mods>(?:(?:public|private|protected|static|async|abstract|override|readonly|get|set|declare)\s+)*)(?:\*\s*)?(?P<name>#?[\w$]+)\s*\??\s*(?=[(<])")
_T_ARROW = re.compile(r"(?P<mods>(?:(?:public|private|protected|static|override|readonly)\s+)*)(?P<name>#?[\w$]+)\s*(?::[^=;{}]*)?=\s*(?P<async>async\s+)?(?=[(<\w])")
_T_MEMBER = re.compile(r"(?P<mods>(?:(?:public|private|protected|static|override|readonly|declare)\s+)*)(?P<name>#?[\w$]+)\s*[?!]?\s*(?=[:=;])")
_T_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "super", "await", "typeof", "constructor_"}
_T_UPPER = re.compile(r"[A-Z][A-Z0-9_]*")
_T_CALL = re.compile(r"(?P<object>[\w$]+)\.(?P<name>\w+)\s*(?=\()")


def _arrow(s: Source, at: int) -> tuple[int, int, int, int] | None:
    """(from, to of the parameters, end of the head, end) of an arrow function or function expression that begins here."""
    at = s.skip(at)
    if m := re.compile(r"async\b\s*").match(s.code, at):
        at = m.end()
    if m := re.compile(r"function\b\s*\*?\s*[\w$]*\s*").match(s.code, at):
        opener = s.skip(s.generics(m.end()))
        closer = s.close(opener)
        brace, head_end = s.body(closer + 1)
        return (opener + 1, closer, head_end, s.close(brace) + 1) if brace is not None else None
    at = s.skip(s.generics(at))
    if s.code.startswith("(", at):
        first, last, after = at + 1, s.close(at), s.close(at) + 1
    elif m := re.compile(r"[\w$]+").match(s.code, at):
        first, last, after = at, m.end(), m.end()
    else:
        return None
    arrow = re.compile(r"\s*(?::(?:[^=;{}]|=(?!>)|\{[^{}]*\})*?)?=>").match(s.code, after)
    if not arrow:
        return None
    start = s.skip(arrow.end())
    end = s.close(start) + 1 if s.code.startswith("{", start) else _statement_end(s, start)
    return first, last, arrow.end() - 2, end


def _returned(s: Source, closer: int, end: int) -> str | None:
    found = re.match(r"\s*:\s*(.*)$", s.code[closer + 1 : end], re.S)
    return s.cut(closer + 1 + found.start(1), closer + 1 + found.end(1)) if found else None


def _first_string(s: Source, a: int, b: int) -> str | None:
    at = s.skip(a)
    if at < b and s.code[at] in "'\"`":
        end = s.code.find(s.code[at], at + 1, b)
        return s.text[at : end + 1] if s.code[at] == "`" else s.text[at + 1 : end]
    return None


def _object_keys(s: Source, a: int, b: int) -> list[str]:
    """Keys of the object literal that begins at or after ``a``."""
    at = s.skip(a)
    if at >= b or s.code[at] != "{":
        return []
    keys = [re.match(r"['\"]?([\w$]+)['\"]?\s*(?::|\(|$)", x) for x in s.split(at + 1, s.close(at))]
    return [k[1] for k in keys if k]


def _script_class(s: Source, m: re.Match, depth: int) -> tuple[dict, list[str], int] | None:
    brace, _ = s.body(m.end())
    if brace is None:
        return None
    at = s.skip(m.start())
    own, first = s.marks(at, r"@[\w.]+\s*")
    inner = [s.cut(at + x.start(), at + x.end()) for x in re.finditer(r"@[\w.]+(?:\([^)]*\))?", s.code[at : m.end()])]
    name, end = m["name"] or "<anonymous>", s.close(brace)
    after = s.generics(m.end())
    bases = []
    for found in re.finditer(r"\b(?:extends|implements)\b(.*?)(?=\bimplements\b|$)", s.code[after:brace], re.S):
        bases += s.split(after + found.start(1), after + found.end(1))
    methods, members = [], []
    for f in _T_METHOD.finditer(s.code, brace + 1, end):
        if s.depth(f.start("name")) != depth + 1 or f["name"] in _T_WORDS:
            continue
        before = s.code[brace : f.start()].rstrip()
        decorated = re.search(r"@[\w.]+(?:\([^()]*\))?$", before[-200:])
        if before[-1:] not in ("{", "}", ";") and not decorated and "\n" not in s.code[len(s.code[: f.start()].rstrip()) : f.start()]:
            continue
        opener = s.skip(s.generics(f.end()))
        if not s.code.startswith("(", opener) or before[-1:] in ("=", "."):
            continue
        closer = s.close(opener)
        inside, head_end = s.body(closer + 1)
        if inside is not None and not re.fullmatch(r"\s*(?::.*)?", s.code[closer + 1 : head_end], re.S):
            continue
        if inside is None and not ("abstract" in f["mods"] or re.match(r"\s*:", s.code[closer + 1 :])):
            continue
        marks, start = s.marks(f.start(), r"@[\w.]+\s*")
        methods.append(_function(s, f.start(), f["name"], name, head_end, s.close(inside) + 1 if inside is not None else head_end + 1, s.split(opener + 1, closer), _returned(s, closer, head_end), marks, start, "async" in f["mods"]))
    for f in _T_ARROW.finditer(s.code, brace + 1, end):
        if s.depth(f.start("name")) == depth + 1 and (found := _arrow(s, f.end() - len(f["async"] or ""))):
            marks, start = s.marks(f.start(), r"@[\w.]+\s*")
            methods.append(_function(s, f.start(), f["name"], name, found[2], found[3], s.split(found[0], found[1]), _returned(s, found[1], found[2]), marks, start, bool(f["async"])))
    named = {x["name"] for x in methods}
    for f in _T_MEMBER.finditer(s.code, brace + 1, end):
        if s.depth(f.start("name")) == depth + 1 and f["name"] not in named and s.code[brace : f.start()].rstrip()[-1:] in ("{", "}", ";", ")") and not _inside(s, f.start(), brace):
            members.append(f["name"])
    methods.sort(key=lambda x: x["line_start"])
    start = m.start("export") if m["export"] else at
    return _class(s, name, start, end + 1, bases, [*own, *inner], first, methods), members, end


def _inside(s: Source, at: int, brace: int) -> bool:
    """Whether a place lies in round or square brackets of the block at ``brace``."""
    k = brace + 1
    while k < at:
        if s.code[k] in "([{":
            if s.close(k) > at:
                return True
            k = s.close(k)
        k += 1
    return False


def script(text: str, path: str = "", *, types: bool = True) -> dict:
    s, out = Source(text, "typescript"), empty()
    places: list[tuple[int, dict]] = []
    functions: list[tuple[int, dict]] = []

    def export(m: re.Match, name: str, kind: str) -> None:
        if m["export"]:
            places.append((m.start("export"), {"name": name, "kind": "default" if m["default"] else kind}))

    for m in s.heads(_T_FUNC, depth=None):
        if s.depth(s.skip(m.start())) != 0:
            continue
        opener = s.skip(s.generics(m.end()))
        if not s.code.startswith("(", opener):
            continue
        closer = s.close(opener)
        brace, head_end = s.body(closer + 1)
        name, at = m["name"] or "<anonymous>", s.skip(m.start())
        export(m, name, "function")
        if m["name"]:
            functions.append((at, _function(s, at, name, None, head_end, s.close(brace) + 1 if brace is not None else head_end + 1, s.split(opener + 1, closer), _returned(s, closer, head_end), [], at, bool(m["async"]))))
    for m in s.heads(_T_VAR):
        end = _statement_end(s, m.end())
        equals = re.compile(r"\s*(?::(?:[^=;]|=>)*?)?=(?![=>])").match(s.code, m.end(), end)
        at = s.skip(m.start())
        names = [m["name"]] if re.fullmatch(r"[\w$]+", m["name"]) else []
        for n in names:
            export(m, n, "variable")
        if not equals:
            continue
        required = re.compile(r"\s*require\s*\(").match(s.code, equals.end())
        if required and (module := _first_string(s, required.end(), len(s.code))) is not None:
            listed = names or [re.split(r"\s*[:=]", x)[0].strip() for x in s.split(m.start("name") + 1, m.end("name") - 1)]
            out["imports"].append({"module": module, "names": listed, "is_relative": module.startswith(("./", "../")), "alias": names[0] if names else None})
        elif names and (found := _arrow(s, equals.end())):
            is_async = s.code.startswith("async", s.skip(equals.end()))
            functions.append((at, _function(s, at, names[0], None, found[2], found[3], s.split(found[0], found[1]), _returned(s, found[1], found[2]), [], at, is_async)))
        if m["word"] == "const" and names and _T_UPPER.fullmatch(names[0]):
            value = s.cut(equals.end(), end)
            plain = re.fullmatch(r"""-?[\d.][\w.]*|true|false|null|(['"`]).*\1""", value, re.S)
            out["constants"].append({"name": names[0], "value": value[:200] if plain else None, "line": s.line(at)})
    for m in s.heads(_T_CLASS, depth=None):
        if s.depth(s.skip(m.start())) != 0 or not (found := _script_class(s, m, 0)):
            continue
        record, members, _ = found
        export(m, record["name"], "class")
        out["classes"].append(record)
        if any("@Entity" in x for x in record["decorators"]):
            out["db_models"].append({"name": record["name"], "fields": members})
    for m in s.heads(_T_TYPE):
        at = s.skip(m.start())
        brace, head_end = s.body(m.end()) if m["kind"] != "type" else (None, _statement_end(s, s.code.find("=", m.end())))
        if types:
            out["type_defs"].append(_type(s, m["name"], {"type": "type_alias"}.get(m["kind"], m["kind"]), at, s.close(brace) + 1 if brace is not None else head_end))
        export(m, m["name"], "type")
    for m in s.heads(_T_IMPORT, depth=None):
        if s.depth(s.skip(m.start())) != 0 or (module := _first_string(s, m.end(), len(s.code))) is None:
            continue
        clause = re.sub(r"^\s*type\b(?!\s*,|\s+from\b)|\bfrom\s*$", "", m["clause"]).strip()
        inner = re.search(r"\{([^}]*)\}", clause)
        star = re.search(r"\*\s*as\s+([\w$]+)", clause)
        lead = re.match(r"([\w$]+)", clause)
        names = [lead[1]] if lead else []
        names += ["*"] if star else []
        names += [re.split(r"\s+as\s+", re.sub(r"^type\s+", "", x.strip()))[0] for x in inner[1].split(",") if x.strip()] if inner else []
        out["imports"].append({"module": module, "names": names, "is_relative": module.startswith(("./", "../")), "alias": star[1] if star else None})
    for m in s.heads(_T_LIST, depth=None):
        places += [(m.start(), {"name": re.split(r"\s+as\s+", re.sub(r"^type\s+", "", x.strip()))[0], "kind": "variable"}) for x in m["names"].split(",") if x.strip()]
    for m in s.heads(_T_DEFAULT, depth=None):
        word = m["name"] if m["name"] and not re.match(r"\s*[(.\[]", s.code[m.end() :]) and m["name"] not in ("new", "async", "await") else None
        if word or not places:
            places.append((m.start(), {"name": word or "default", "kind": "default"}))
    out["functions"] = [f for _, f in sorted(functions, key=lambda p: p[0])]
    out["exports"] = [e for _, e in sorted(places, key=lambda p: p[0])]
    _script_calls(s, out)
    where = re.search(r"app(/api/.+)/route\.[jt]sx?$", path.replace("\\", "/")) or re.search(r"pages(/api/.+)\.[jt]sx?$", path.replace("\\", "/"))
    if where:
        verbs = [e["name"] for e in out["exports"] if e["kind"] == "function" and e["name"].lower() in [*HTTP, "all"]] if "/route." in path else []
        out["route_handlers"] += [{"path": where[1], "method": v.upper(), "handler_function": v.upper()} for v in verbs] or [{"path": where[1], "method": "*", "handler_function": ""}]
    return out


def _script_calls(s: Source, out: dict) -> None:
    """Routes and models that are made by calls, wherever they stand."""
    procedures = []
    for m in _T_CALL.finditer(s.code):
        opener = m.end()
        if (m["object"] in ROUTERS or m["object"].endswith("Router")) and m["name"] in [*HTTP, "all"] and s.code[m.start() - 1 : m.start()] != ".":
            args = s.split(opener + 1, s.close(opener))
            last = args[-1] if len(args) > 1 else ""
            handler = last if re.fullmatch(r"[\w$]+", last) else "<anonymous>" if re.match(r"(?:async\s+)?function\b", last) else "<arrow>" if "=>" in last else ""
            out["route_handlers"].append({"path": _first_string(s, opener + 1, s.close(opener)) or "", "method": m["name"].upper(), "handler_function": handler})
        if m["object"] == "mongoose" and m["name"] == "model":
            out["db_models"].append({"name": _first_string(s, opener + 1, s.close(opener)) or "Model", "fields": []})
    for m in re.finditer(r"\.\s*(query|mutation|subscription)\s*(?:<[^<>()]*>\s*)?(?=\()", s.code):
        procedures.append({"path": f"trpc.{m[1]}", "method": m[1].upper(), "handler_function": ""})
    out["route_handlers"] += procedures
    for m in re.finditer(r"(?:(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]*)?=\s*)?new\s+(?:[\w$]+\.)*Schema\s*(?:<[^<>()]*>\s*)?(?=\()", s.code):
        out["db_models"].append({"name": m[1] or "Schema", "fields": _object_keys(s, m.end() + 1, s.close(m.end()))})
    for m in re.finditer(rf"(?<![\w$.])({'|'.join(TABLES)})\s*(?=\()", s.code):
        args = s.code.find(",", m.end(), s.close(m.end()))
        out["db_models"].append({"name": _first_string(s, m.end() + 1, s.close(m.end())) or m[1], "fields": _object_keys(s, args + 1, s.close(m.end())) if args >= 0 else []})


READERS = {"go": go, "rust": rust, "java": java, "typescript": script, "javascript": lambda text, path="": script(text, path, types=False)}
