"""Registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bytenet, decontam, langid, merkle, negatives, ngramjoin, packing, passages, pii, secrets, suffixdedup, tokencount, vectors
from quarry.llm._base import read


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file of the installed collection."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.train(docs, where=~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(read(spark, sf_dir, "documents")).drop("spans")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches of all documents; ``op7_decontamination`` keeps the columns of its SQL."""
    found = decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), span=20)
    return found.select("doc_id", "n_words", F.size("near_words").cast("long").alias("n_near"), F.size("near_item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("near_item_ids", ","), 256).alias("items_sha256"), (F.size("near_words") > 0).alias("contaminated"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    base = list(pii.PATTERNS)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(pii.KINDS).alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = bytenet.train(docs.where(~held_out), read(spark, sf_dir, "labels"))
    found = bytenet.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"), merkle.lowered())


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), anchors=F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_decontamination": op7_decontamination,
    "op7_proximity": op7_proximity,
    "op8_secrets": op8_secrets,
    "op9_pii": op9_pii,
    "op10_token_counts": op10_token_counts,
    "op11_quality": op11_quality,
    "op12_merkle": op12_merkle,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op7_decontamination"] = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[k : k + 9], ' ') AS phrase, least(len(w), 10) AS n
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(k) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS phrase
  FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS r(k)),
occ AS (SELECT doc_id, k, s.n, item_id FROM spots s JOIN win USING (phrase, n)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(k, k + n)) AS r(p) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM occ GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE_SQL["op6_ngram_join"] = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS s
  FROM dw, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS r(k) WHERE len(w) > 0),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT a, b FROM sym
  UNION
  SELECT r.doc_id, s.b FROM reach r JOIN sym s ON r.other = s.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sz USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id, n
"""

ORACLE_SQL["op5_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sym AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, other) AS (
  SELECT a, b FROM sym UNION SELECT r.vec_id, s.b FROM reach r JOIN sym s ON r.other = s.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM sym GROUP BY a),
c AS (SELECT e.vec_id, least(e.vec_id, coalesce(min(other), e.vec_id)) AS component_id FROM embeddings e LEFT JOIN reach USING (vec_id) GROUP BY e.vec_id)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""

ORACLE_SQL["op4_suffix_dedup"] = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS g FROM h, unnest(range(0, length(x) // 2 - 49)) AS r(k)),
least_of AS (SELECT g, min(doc_id) AS lo FROM w GROUP BY g),
hit AS (SELECT doc_id, k FROM w JOIN least_of USING (g) WHERE lo < doc_id),
cut AS (SELECT doc_id, k, k - coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k), -100) > 50 AS fresh FROM hit),
numbered AS (SELECT doc_id, k, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY k) AS s FROM cut),
span AS (SELECT doc_id, s, min(k) AS a, max(k) + 50 AS b FROM numbered GROUP BY doc_id, s),
edge AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, b FROM span),
kept AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS pieces
  FROM edge JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(pieces || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)
"""


def _levels(name: str, group: str, most: int) -> str:
    """Nodes of all levels of the trees of {name}0 ({group}, idx, h), with what stands beside each of them; ``most`` levels hold 16**most leaves a tree."""
    out = []
    for k in range(most + 1):
        out.append(f"""
{name}s{k} AS (
  SELECT {group}, idx, h, count(*) OVER (PARTITION BY {group}) AS c,
    coalesce(string_agg(h, '') OVER (PARTITION BY {group}, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY {group}, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{k}),
{name}{k + 1} AS (
  SELECT {group}, idx // 16 AS idx, CASE WHEN any_value(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h
  FROM {name}s{k} GROUP BY {group}, idx // 16)""")
    return ",".join(out)


def _climb(name: str, on: str, start: str, most: int) -> str:
    """Rows of ``start`` (…, idx, f, proof) carried to the top of their tree."""
    out, last = [], start
    for k in range(most + 1):
        out.append(f"""
{start}_{k} AS (
  SELECT x.* EXCLUDE (idx, f, proof), x.idx // 16 AS idx, CASE WHEN c = 1 THEN f ELSE sha256(l || f || r) END AS f, proof || l || r AS proof
  FROM {last} x JOIN {name}s{k} s ON {on} AND x.idx = s.idx)""")
        last = f"{start}_{k}"
    return ",".join(out)


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BYTE = "lambda c, ch: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, ascii(ch)::BIGINT))"
_CRC = f"xor(list_reduce(string_split(doc_id::VARCHAR, ''), {_BYTE}, 4294967295::BIGINT), 4294967295)"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_FIELD.format(text if c == "text" else c) for c in merkle.FIELDS) + "))"


#: 16**7 leaves a source and as many sources.
_MOST = 6
ORACLE_SQL["op12_merkle"] = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_LOWERED)} END AS changed
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
a0 AS (SELECT tree, idx, leaf AS h FROM numbered),{_levels("a", "tree", _MOST)},
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM a{_MOST + 1}),
b0 AS (SELECT 0 AS top, place AS idx, subroot AS h FROM subroots),{_levels("b", "top", _MOST)},
inside AS (SELECT doc_id, tree, leaf, idx, coalesce(changed, leaf) AS f, '' AS proof FROM numbered),{_climb("a", "x.tree = s.tree", "inside", _MOST)},
outside AS (SELECT doc_id, leaf, subroot, place AS idx, f, proof FROM inside_{_MOST} JOIN subroots USING (tree)),{_climb("b", "s.top = 0", "outside", _MOST)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified
FROM outside_{_MOST}, b{_MOST + 1}
"""

ORACLE_SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
