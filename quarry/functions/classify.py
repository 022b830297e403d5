"""Which files of a repository count, what type they are, and their language."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SKIP_DIRS = ["node_modules", ".git", "__pycache__", ".next", "dist", "build", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "vendor", ".cargo", "target", ".eggs", "__pypackages__", ".ruff_cache"]
SKIP_SUFFIXES = [".min.js", ".min.css", ".map", ".lock", ".sum"]
BINARY_EXTENSIONS = [".svg", ".png", ".jpg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pyc", ".pyo", ".so", ".dylib", ".dll"]
CONFIG_NAMES = ["package.json", "tsconfig.json", "pyproject.toml", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "makefile", "cargo.toml", "go.mod", "go.sum", "setup.py", "setup.cfg", ".gitignore"]
CONFIG_PREFIXES = [".env", ".eslintrc", ".prettierrc"]
CONFIG_STEMS = ["jest.config", "webpack.config", "vite.config", "next.config"]
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java"}
TEST_DIRS = ["test", "tests", "__tests__", "spec"]
DOC_ENDINGS = [".md", ".mdx", ".rst"]
DOC_STEMS = ["license", "changelog", "contributing"]
MAX_BYTES = 100 * 1024


def _either(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


# Each rule is one pattern over the whole path, its last part being what follows the last slash: a filter that names
# the base name in every rule repeats it there, and the repeats outgrow what Spark compiles.


def in_skipped_dir(path: Column, names: list[str] | None = None) -> Column:
    return path.rlike(f"(?:^|/){_either(names or SKIP_DIRS)}/")


def has_skipped_suffix(path: Column) -> Column:
    return path.rlike(f"(?i){_either(SKIP_SUFFIXES)}$")


def is_binary_name(path: Column) -> Column:
    return path.rlike(f"(?i){_either(BINARY_EXTENSIONS)}$")


def is_test(path: Column) -> Column:
    """Below a folder of tests, or named so: a test_ before the stem, or a test or spec after it."""
    return path.rlike(f"(?:^|/){_either(TEST_DIRS)}/") | path.rlike(r"(?i)(?:^|/)test_[^/]*\.[^/]+$|(?:[._]test|[._]spec)\.[^/]+$")


def is_config(path: Column) -> Column:
    """A known name, a known beginning, or .config inside a name."""
    return path.rlike(f"(?i)(?:^|/)(?:{_either(CONFIG_NAMES)}|{_either(CONFIG_PREFIXES + CONFIG_STEMS)}[^/]*|[^/]+\\.config[^/]*)$")


def is_doc(path: Column) -> Column:
    return path.rlike(f"(?i){_either(DOC_ENDINGS)}$|(?:^|/){_either(DOC_STEMS)}[^/]*$")


def file_type(path: Column) -> Column:
    return F.when(is_test(path), "test").when(is_config(path), "config").when(is_doc(path), "doc").otherwise("code")


def language(path: Column) -> Column:
    """Language by extension; null when unknown."""
    pairs = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return pairs[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))]


def language_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda s: F.lower(F.trim(s))), lambda s: s != "")


def ignore_pattern(line: str) -> str | None:
    """A regular expression over relative paths for one line of an ignore file; None for blanks, comments and negations."""
    line = line.rstrip()
    if not line or line.startswith(("#", "!")):
        return None
    rooted, only_dirs = "/" in line.rstrip("/"), line.endswith("/")
    out, rest = "", line.strip("/")
    while rest:
        if rest.startswith("**/"):
            out, rest = out + "(?:.*/)?", rest[3:]
        elif rest.startswith("**"):
            out, rest = out + ".*", rest[2:]
        else:
            c = rest[0]
            out, rest = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".+()[]{}^$|\\" else c), rest[1:]
    return ("^" if rooted else "(?:^|/)") + out + ("/" if only_dirs else "(?:/|$)")


def is_ignored(path: Column, lines: list[str]) -> Column:
    patterns = [p for p in map(ignore_pattern, lines) if p]
    return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def is_discovered(path: Column, size: Column, languages: list[str] | None = None, ignore: list[str] | None = None) -> Column:
    """All skip rules, the size cap, the ignore file and the language rule."""
    kind, lang = file_type(path), language(path)
    kept = ~in_skipped_dir(path) & ~has_skipped_suffix(path) & ~is_binary_name(path) & (size <= MAX_BYTES) & ~is_ignored(path, ignore or [])
    if languages:
        return kept & (kind.isin("config", "doc") | F.coalesce(lang.isin(languages), F.lit(False)))
    return kept & ((kind != "code") | lang.isNotNull())


def is_parsed(path: Column) -> Column:
    return language(path).isNotNull() & file_type(path).isin("code", "test")
