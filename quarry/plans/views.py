"""Code-shaped views of the driver's tables, in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_files": """
SELECT doc_id AS ord, source || '/' || lang || '/' || CASE doc_id % 9 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'node_modules/pkg/' WHEN 3 THEN 'lib/'
    WHEN 4 THEN '__tests__/' WHEN 5 THEN 'dist/' WHEN 6 THEN 'spec/' WHEN 7 THEN 'docs/' ELSE '' END || CASE doc_id % 14 WHEN 0 THEN 'doc_' || CAST(doc_id AS STRING) || '.py'
    WHEN 1 THEN 'doc_' || CAST(doc_id AS STRING) || '.ts' WHEN 2 THEN 'doc_' || CAST(doc_id AS STRING) || '.js' WHEN 3 THEN 'doc_' || CAST(doc_id AS STRING) || '.go'
    WHEN 4 THEN 'doc_' || CAST(doc_id AS STRING) || '.rs' WHEN 5 THEN 'Doc' || CAST(doc_id AS STRING) || '.java' WHEN 6 THEN 'test_doc_' || CAST(doc_id AS STRING) || '.py'
    WHEN 7 THEN 'doc_' || CAST(doc_id AS STRING) || '.test.ts' WHEN 8 THEN CAST(doc_id AS STRING) || '/package.json' WHEN 9 THEN 'doc_' || CAST(doc_id AS STRING) || '.min.js'
    WHEN 10 THEN 'README_' || CAST(doc_id AS STRING) || '.md' WHEN 11 THEN 'doc_' || CAST(doc_id AS STRING) || '.svg' WHEN 12 THEN '.env.' || CAST(doc_id AS STRING)
    ELSE 'doc_' || CAST(doc_id AS STRING) || '.xyz' END AS path, n_chars AS size_bytes, text, {sha}(text) AS hash
FROM {documents} WHERE text IS NOT NULL""",
    "v_place": """
SELECT n_nationkey AS nk, n_name, r_name, r_name || '/' || n_name || '.py' AS file FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "v_nodes": """
SELECT 'file::' || file AS id, 'file' AS kind, file AS name, file, CAST(nk AS BIGINT) AS ord FROM v_place
UNION ALL SELECT 'class::' || file || '::' || s_name, 'class', s_name, file, 1000 + s_suppkey FROM {supplier} JOIN v_place ON s_nationkey = nk
UNION ALL SELECT 'func::' || file || '::' || c_name, 'function', c_name, file, 1000000 + c_custkey FROM {customer} JOIN v_place ON c_nationkey = nk
UNION ALL SELECT 'type::' || file || '::' || p_name || CAST(p_partkey AS STRING), 'type', p_name, file, 100000000 + p_partkey FROM {part} JOIN v_place ON p_partkey % 25 = nk""",
    "v_raw_edges": """
SELECT 'file::' || a.file AS src, 'file::' || b.file AS dst, 'IMPORTS' AS relation FROM v_place a JOIN v_place b ON (a.nk * 7 + 3) % 25 = b.nk OR (a.nk * 3 + 1) % 25 = b.nk
UNION ALL SELECT 'file::' || file, 'file::missing.py', 'IMPORTS' FROM v_place
UNION ALL SELECT DISTINCT 'func::' || f.file || '::' || c_name, 'class::' || g.file || '::' || s_name, 'CALLS'
  FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {supplier} ON s_suppkey = l_suppkey
  JOIN v_place f ON f.nk = c_nationkey JOIN v_place g ON g.nk = s_nationkey
UNION ALL SELECT 'file::' || file, id, 'CONTAINS' FROM v_nodes WHERE kind <> 'file'
UNION ALL SELECT 'file::' || file, id, 'CALLS' FROM v_nodes WHERE kind = 'class' AND ord % 3 = 0""",
    "v_edges": """
SELECT src, dst, CASE max(CASE relation WHEN 'IMPORTS' THEN 1 WHEN 'CALLS' THEN 2 ELSE 3 END) WHEN 1 THEN 'IMPORTS' WHEN 2 THEN 'CALLS' ELSE 'CONTAINS' END AS relation
FROM v_raw_edges WHERE dst <> 'file::missing.py' GROUP BY src, dst""",
    "v_ranked": """
SELECT id, kind, name, n.file, ord, CAST(ord * 37 % 101 AS DOUBLE) / 100 AS pagerank, r_name AS module FROM v_nodes n JOIN v_place p ON n.file = p.file""",
    "v_docs": """
SELECT n_name || '.md' AS name, '# ' || n_name || chr(10) || 'See `' || n_name || '` because it ensures order, never skip.' || chr(10) || CASE nk % 3 WHEN 0 THEN '## Quick Commands' || chr(10) ELSE '' END
    || '## Key Files' || chr(10) || '- `' || file || '`' || chr(10) || CASE nk % 4 WHEN 0 THEN '- `lost/' || n_name || '.py`' || chr(10) ELSE '' END || '- `./' || file || '`' || chr(10)
    || CASE nk % 2 WHEN 0 THEN '## Non-Obvious Patterns' || chr(10) || '## See Also' || chr(10) ELSE '' END || repeat('line of parameter text' || chr(10), CAST(nk * 4 AS INT))
    || '- `' || lower(r_name) || '` and `Ghost' || CAST(nk AS STRING) || '`' || chr(10) AS text, r_name, n_name, nk FROM v_place""",
    "v_manifest": """
SELECT path, CASE WHEN ord % 7 = 0 THEN hash || 'x' ELSE hash END AS hash FROM v_files WHERE ord % 10 <> 0
UNION ALL SELECT 'gone/' || path, hash FROM v_files WHERE ord % 25 = 0""",
    "v_assigned": "SELECT path, 'm' || CAST(ord % 12 AS STRING) AS module FROM v_files WHERE ord % 10 <> 0",
    "v_imports": """
SELECT s_suppkey AS imp, file, CASE s_suppkey % 5 WHEN 4 THEN 'typescript' WHEN 3 THEN 'javascript' ELSE 'python' END AS language,
  CASE s_suppkey % 10 WHEN 0 THEN 'os.path' WHEN 1 THEN r_name || '.' || n_name WHEN 2 THEN r_name WHEN 3 THEN 'react/dom' WHEN 4 THEN './' || n_name WHEN 5 THEN n_name WHEN 6 THEN 'nowhere.at.all'
    WHEN 7 THEN '.' || n_name WHEN 8 THEN '@app/' || n_name ELSE '../' || r_name || '/' || n_name END AS module, n_name AS wanted
FROM {supplier} JOIN v_place ON s_nationkey = nk""",
    "v_functions": """
SELECT c_custkey AS k, file, CASE WHEN c_custkey % 3 = 0 THEN '_' ELSE '' END || 'f' || CAST(c_custkey % 40 AS STRING) AS name, 'C' || CAST(c_custkey % 4 AS STRING) AS cls, '@pkg.d' || CAST(c_custkey % 5 AS STRING) || '(1)' AS decorator,
  'list[' || CASE c_custkey % 3 WHEN 0 THEN 'f' || CAST(c_custkey * 7 % 40 AS STRING) ELSE 'T' || CAST(c_custkey % 6 AS STRING) END || ']' AS return_type FROM {customer} JOIN v_place ON c_nationkey = nk""",
    "v_names": """
SELECT DISTINCT file, CASE WHEN s_suppkey % 2 = 0 THEN 'd' || CAST(s_suppkey % 5 AS STRING) ELSE 'T' || CAST(s_suppkey % 6 AS STRING) END AS name, 'lib/' || CAST(s_suppkey % 7 AS STRING) || '.py' AS target
FROM {supplier} JOIN v_place ON s_nationkey = nk""",
}
_DEPENDS = {n: [d for d in VIEWS if d != n and d in VIEWS[n]] for n in VIEWS}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS[n]:
            add(d)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def _ctes(names: tuple[str, ...], tokens: dict[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**tokens)})" for n in _order(names))


def oracle(sql: str, *names: str) -> str:
    """SQL for the other engine, with the views it needs in front; SQL that begins with WITH goes on after them."""
    tokens = {t: t for t in TABLES} | {"sha": "sha256"}
    body = sql.strip()
    if not names:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return _ctes(names, tokens).replace("WITH", "WITH RECURSIVE", 1) + ", " + body[14:]
    if body[:4].upper() == "WITH":
        return _ctes(names, tokens) + ", " + body[4:]
    return f"{_ctes(names, tokens)}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tokens = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES} | {"sha": "SHA256_OF"}
    text = f"{_ctes((name,), tokens)}\nSELECT * FROM {name}".replace("SHA256_OF(text)", "sha2(text, 256)")
    return spark.sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
