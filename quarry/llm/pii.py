"""PII by information-theoretic sanitisation, with DataFrame expressions only.

Base entities (e-mail, IP, card, phone) are found by pattern and checks.  Then
corpus co-occurrence tells how strongly a word reveals an entity: for a term t
that stands within ``reach`` characters of entity e, n(t, e) documents hold t
there, n(t) hold t anywhere, n(e) hold e, of N documents.  Its disclosure is the
pointwise information log2(n(t, e) N / (n(t) n(e))) as a part of all that e could
lose, log2(N / n(e)), so frequent entities and small tables are judged alike.  A
term discloses e if that part is at least ``disclosure``, the conditional share
n(t, e) / n(t) at least ``share``, and the pair stands in at least ``support``
different texts.  A disclosing term becomes a span of kind ``term`` wherever it
stands, in whichever document; ``sanitise`` generalises terms and removes
entities.  An entity of all documents loses nothing and has no terms.

Terms are runs of two or more letters and digits, compared in lower case.  They
are read from a text whose entities are blanked, kind by kind as listed, with
``BLANK``; a run that touches a blank is none, nor is one that reach cuts off.

All counts cover all documents and are pre-aggregated before each shuffle.  The
work on a text grows with its length, not with its length times its spans:
matches are placed in blocks, and stretches are cut from pieces of the text.
Offsets are code points, end exclusive.  A null text is empty.  Repeated rows get
equal results (each counts as a document, but not as a different text); other
columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import split_by_ids, table

KINDS = ["email", "ip", "card", "phone", "term"]
_LOCAL = r"[A-Za-z0-9._%+-]"
#: The contract's patterns with possessive repeats: nothing that follows a repeat can begin inside it, so the matches are
#: the same, and long runs take linear time.  An e-mail can only begin where its run begins or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stands for each character of an entity while terms are read; a private-use character, neither letter nor digit.
BLANK = "\ue000"
_TERM = rf"(?<![\p{{L}}\p{{N}}{BLANK}])[\p{{L}}\p{{N}}]{{2,}}+(?!{BLANK})"
_SPAN = "array<struct<start:int,end:int,value:string>>"
#: Code points of one piece of a text; a stretch is cut from the pieces it lies in.
PIECE = 1024
_PIECES = rf"(?s).{{1,{PIECE}}}"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: F.length(_digits(v)).between(16, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}
#: A text without this has no match, and no pattern is run over it.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _gaps(text: Column, pattern: str) -> Column:
    """Gaps and matches as they alternate; the last gap has no match."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("value")))


def _blocks(items: Column) -> Column:
    """An array in blocks of about the root of its size: appending to a block copies little, however long the whole is."""

    def cut(x: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
        return _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / w).cast("int")), lambda b: F.slice(x, b * w + 1, w)))

    return _let(items, lambda x: F.when(F.size(x) > 0, cut(x)).otherwise(F.slice(F.array(x), 1, 0)))


def matches(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Valid non-overlapping matches with their places: lengths of gaps and matches add up to the offsets, first inside blocks, then over them."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        own = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        keep = x["value"].isNotNull() & valid(x["value"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    def over(acc: Column, block: Column) -> Column:
        moved = lambda got: F.transform(got["found"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end"), m["value"].alias("value")))
        return _let(F.aggregate(block, zero, step), lambda got: F.struct((acc["at"] + got["at"]).alias("at"), F.concat(acc["found"], F.array(moved(got))).alias("found")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("found"))
    return F.aggregate(_blocks(_gaps(text, pattern)), none, over, lambda acc: F.flatten(acc["found"]))


def _possible(text: Column, kind: str) -> Column:
    has = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
    return has & text.rlike("[0-9]") if kind in ("ip", "card") else has


def _base(text: Column, kind: str) -> Column:
    return F.when(_possible(text, kind), matches(text, PATTERNS[kind], VALID[kind])).otherwise(F.array().cast(_SPAN))


def blanked(text: Column) -> Column:
    """The text with its entities blanked, kind by kind; all places stay."""

    def blank(kind: str) -> Callable[[Column], Column]:
        def match(x: Column) -> Column:
            filled = F.when(VALID[kind](x["value"]), F.repeat(F.lit(BLANK), F.length(x["value"]))).otherwise(x["value"])
            return F.concat(x["gap"], F.coalesce(filled, F.lit("")))

        return lambda t: F.when(_possible(t, kind), F.array_join(F.transform(_gaps(t, PATTERNS[kind]), match), "")).otherwise(t)

    for kind in PATTERNS:
        text = _let(text, blank(kind))
    return text


def _stretch(pieces: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor(end / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE + 1, end - start)


def _entity(kind: str, span: Column) -> Column:
    return F.xxhash64(F.lit(kind), F.lower(span["value"]))


def _near(text: Column, spans: dict[str, Column], reach: int) -> Column:
    """Different "entity term" pairs of a text: the words around each base span."""

    def around(kind: str, clean: Column, pieces: Column) -> Callable[[Column], Column]:
        def one(s: Column) -> Column:
            lo, hi = F.greatest(s["start"] - reach, F.lit(0)), F.least(s["end"] + reach, F.length(clean))
            window = _stretch(pieces, lo, hi)
            window = F.when(lo > 0, F.regexp_replace(window, r"^[\p{L}\p{N}]++", BLANK)).otherwise(window)
            window = F.when(hi < F.length(clean), F.regexp_replace(window, r"(?<![\p{L}\p{N}])[\p{L}\p{N}]++$", BLANK)).otherwise(window)
            return F.transform(F.regexp_extract_all(window, F.lit(_TERM), F.lit(0)), lambda w: F.concat(_entity(kind, s).cast("string"), F.lit(" "), F.lower(w)))

        return one

    def pairs(clean: Column, pieces: Column) -> Column:
        return F.array_distinct(F.flatten(F.concat(*(F.transform(s, around(kind, clean, pieces)) for kind, s in spans.items()))))

    return _let(blanked(text), lambda clean: _let(F.regexp_extract_all(clean, F.lit(_PIECES), F.lit(0)), lambda pieces: pairs(clean, pieces)))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def base_entities(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 40) -> DataFrame:
    """id, text_key (a hash of the text), one array of spans per base kind, and the different pairs of entities and terms near them."""
    rows = _rows(df, id_col, text_col).select("id", "text", "text_key", *(_base(F.col("text"), k).alias(k) for k in PATTERNS))
    some = sum((F.size(k) for k in PATTERNS), F.lit(0)) > 0
    return rows.select("id", "text_key", *PATTERNS, F.when(some, _near(F.col("text"), {k: F.col(k) for k in PATTERNS}, reach)).alias("near"))


def _terms(rows: DataFrame) -> DataFrame:
    """One row for each different term of each row."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(blanked(F.col("text")), F.lit(_TERM), F.lit(0)), F.lower))
    return rows.select("id", "text_key", F.explode(words).alias("term"))


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda s: _entity(kind, s))


def disclosing_terms(entities: DataFrame, rows: DataFrame, *, disclosure: float = 0.75, share: float = 0.8, support: int = 3) -> DataFrame:
    """(entity, term) pairs whose term discloses the entity, with counts and information; ``rows`` are the texts of ``entities``."""
    held = entities.select("text_key", F.explode("near").alias("pair"))
    together = held.groupBy("pair", "text_key").agg(F.count("*").alias("n")).groupBy("pair").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_texts"))
    together = together.where(F.col("n_texts") >= support).select(F.split("pair", " ")[0].cast("long").alias("entity"), F.split("pair", " ")[1].alias("term"), "n_both", "n_texts")
    named = entities.select(F.explode(F.array_distinct(F.concat(*map(_entities, PATTERNS)))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    seen = _terms(rows).groupBy("term").agg(F.count("*").alias("n_term"))
    total = entities.agg(F.count("*").alias("n_all"))
    scored = together.join(named, "entity").join(seen, "term").join(F.broadcast(total))  # one row
    most = F.log2(F.col("n_all") / F.col("n_entity"))
    scored = scored.withColumn("information", F.log2(F.col("n_both") * F.col("n_all") / (F.col("n_term") * F.col("n_entity"))))
    return scored.where((most > 0) & (F.col("information") >= disclosure * most) & (F.col("n_both") >= share * F.col("n_term")))


def find(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 40, disclosure: float = 0.75, share: float = 0.8, support: int = 3) -> DataFrame:
    """id, text_key and one array of spans per kind, ``term`` included."""
    entities = table(base_entities(df, id_col=id_col, text_col=text_col, reach=reach), "pii")
    rows = _rows(df, id_col, text_col)
    risky = disclosing_terms(entities, rows, disclosure=disclosure, share=share, support=support)
    risky = table(risky.select("term").distinct(), "risky")
    holders = table(_terms(rows).join(risky, "term").select("text_key").distinct(), "holders")
    touched, _ = split_by_ids(rows, holders, "text_key")
    words = F.explode(matches(blanked(F.col("text")), _TERM, lambda v: F.lit(True))).alias("w")
    places = touched.select("id", "text_key", words).select("id", "text_key", "w", F.lower("w.value").alias("term")).join(risky, "term")
    places = places.groupBy("id", "text_key").agg(F.array_sort(F.collect_set(F.struct("w.start", "w.end", F.col("term").alias("value")))).alias("term"))
    left, right = entities.alias("l"), places.alias("r")
    on = F.col("l.id").eqNullSafe(F.col("r.id")) & (F.col("l.text_key") == F.col("r.text_key"))
    return left.join(right, on, "left").select(F.col("l.id").alias(id_col), "l.text_key", *(f"l.{k}" for k in PATTERNS), F.coalesce("r.term", F.array().cast(_SPAN)).alias("term"))


def span_text(kinds: list[str]) -> Column:
    """kind:start:end of all spans by kind, then start, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"]))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def sanitise(df: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with each span replaced by its kind in brackets; where spans overlap, the first that begins stands."""

    def marks(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("by")))

    marked = found.select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), F.array_sort(F.concat(*map(marks, KINDS))).alias("_marks")).where(F.size("_marks") > 0)
    marked = table(marked.dropDuplicates(["_id", "_key"]), "marks")
    text = F.col(text_col)

    def replaced(pieces: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            fresh = s["start"] >= acc["at"]
            parts = F.array(_stretch(pieces, acc["at"], F.greatest(s["start"], acc["at"])), s["by"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], parts)).otherwise(acc["out"]).alias("out"))

        def over(acc: Column, block: Column) -> Column:
            inner = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return _let(inner, lambda got: F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(got["out"], ""))).alias("out")))

        none = F.array().cast("array<string>")
        end = lambda acc: F.array_join(F.concat(acc["out"], F.array(_stretch(pieces, acc["at"], F.length(text)))), "")
        return F.aggregate(_blocks(F.col("_marks")), F.struct(F.lit(0).alias("at"), none.alias("out")), over, end)

    clean = _let(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), replaced)
    maybe, clean_rows = split_by_ids(df, marked.select(F.col("_id").alias(id_col)), id_col)  # only texts with spans are shuffled
    keyed = maybe.withColumn("_text_key", F.xxhash64(F.coalesce(text, F.lit(""))))
    on = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    joined = keyed.join(marked, on, "left").withColumn(text_col, F.when(F.col("_marks").isNull(), text).otherwise(clean))
    return joined.select(*df.columns).unionByName(clean_rows)
