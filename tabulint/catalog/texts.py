"""Line scans, line counts, duplicates and scalar functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulint.catalog.registry import Registry, table
from tabulint.functions import scalar as S
from tabulint.operators import aggregates as A
from tabulint.operators import detectors
from tabulint.operators import lines as L
from tabulint.sources import extract as X

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

LINES_SQL = r"""
  SELECT doc_id, source, lang, CAST(i AS BIGINT) AS ln, parts[i] AS line
  FROM (SELECT doc_id, source, lang, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS parts
        FROM documents WHERE text IS NOT NULL AND text <> ''),
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
"""
SECRET_SQL = r"""regexp_matches(line, '(?i)(password|passwd|secret|api[_-]?key|token|access[_-]?key|private[_-]?key)\s*[:=]\s*[''"][^''"]{8,}[''"]')"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lines(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang")


@_r.add(f"SELECT source, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, max(length(line)) AS longest FROM ({LINES_SQL}) GROUP BY source")
def lines_by_source(spark, sf_dir):
    """Shared line reader."""
    return document_lines(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max(F.length("line")).alias("longest"))


@_r.add(
    f"""SELECT lang, source, count(*) AS n_lines, sum(regexp_matches(line, '^\\s*$')::INT)::BIGINT AS blank,
    sum((NOT regexp_matches(line, '^\\s*$'))::INT)::BIGINT AS code FROM ({LINES_SQL}) GROUP BY GROUPING SETS ((lang), (source), ())"""
)
def loc_rollup(spark, sf_dir):
    """A1, A2: lines by language, by source and in all, in one pass."""
    return A.loc_rollup(document_lines(spark, sf_dir), "lang", "source")


def secret_findings(spark, sf_dir) -> DataFrame:
    hits = document_lines(spark, sf_dir).filter(L.is_hardcoded_secret(F.col("line")))
    severity = F.when(F.length("line") > 200, "Medium").otherwise("Critical")
    return hits.select("doc_id", "source", "ln", F.lit("HardcodedSecret").alias("kind"), severity.alias("severity"))


FOUND_SQL = f"""
  SELECT doc_id, source, ln, 'HardcodedSecret' AS kind, CASE WHEN length(line) > 200 THEN 'Medium' ELSE 'Critical' END AS severity
  FROM (SELECT *, regexp_extract(regexp_extract(line, '[:=](.*)$', 1), '^[^''"]*(?:''([^'']*)''|"([^"]*)")', 0) AS q FROM ({LINES_SQL}))
  WHERE {SECRET_SQL} AND NOT regexp_matches(lower(line), 'permission|example|placeholder|default|::class')
    AND NOT (q <> '' AND (regexp_matches(q, '[''"].* .*[''"]$') OR regexp_matches(q, '[{{$%<]')))
"""


@_r.add(f"SELECT doc_id, source, ln, kind, severity FROM ({FOUND_SQL})")
def secret_lines(spark, sf_dir):
    """Lines that assign a secret."""
    return secret_findings(spark, sf_dir)


@_r.add(f"SELECT severity, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY ln) AS rn FROM ({FOUND_SQL})) GROUP BY severity")
def secret_findings_by_severity(spark, sf_dir):
    """Severity counts of D4."""
    return secret_findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@_r.add(
    f"""SELECT doc_id, ln, rank, CASE WHEN rank = 1 THEN greatest(n - 5, 0) ELSE 0 END AS more FROM (
    SELECT doc_id, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS rank, count(*) OVER (PARTITION BY doc_id) AS n
    FROM ({LINES_SQL}) WHERE regexp_matches(line, '\\b(of|the|and)\\b')) WHERE rank <= 5"""
)
def capped_hits(spark, sf_dir):
    """At most five hits a file, the rest as one number."""
    hits = document_lines(spark, sf_dir).filter(F.col("line").rlike(r"\b(of|the|and)\b")).select("doc_id", "ln")
    return L.capped(hits, ["doc_id"], ["ln"], 5)


# lines of code dealt out by line number, one for each rule and each exception to one
CODE = ("$h = md5($password);", "eval($x);", "// eval($x);", "$h = md5($cacheKey);", "$h = sha1($body);", "$ok = 1;", "$key = 'x'; $retrieval(1);", "$api_key = 'Zx9Qp3Lm8Kv2';", "# md5($password);", "amd5($x); md5($y);")


@_r.add(
    f"""WITH l AS (SELECT doc_id, ln % 10 AS k FROM ({LINES_SQL})), f AS (SELECT CASE k WHEN 1 THEN 'EvalUsage' WHEN 7 THEN 'HardcodedSecret' ELSE 'WeakCrypto' END AS kind, CASE k WHEN 4 THEN 'Medium' WHEN 9 THEN 'Medium' ELSE 'Critical' END AS severity FROM l WHERE k IN (0, 1, 4, 7, 9))
    SELECT kind, severity, count(*) AS n FROM f GROUP BY ALL"""
)
def security_lines(spark, sf_dir):
    """Weak hashes, eval and secrets over lines of code."""
    line = F.element_at(F.array(*map(F.lit, CODE)), (F.col("ln") % 10 + 1).cast("int"))
    rows = document_lines(spark, sf_dir).select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".php")).alias("path"), "ln", F.lit("Php").alias("lang"), line.alias("line"))
    return detectors.security(rows).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@_r.add(f"WITH l AS (SELECT ln % 10 AS k FROM ({LINES_SQL})) SELECT CASE WHEN k = 4 THEN 'sha1' ELSE 'md5' END AS name, count(*) AS n FROM l WHERE k IN (0, 3, 4) GROUP BY ALL")
def forbidden_functions(spark, sf_dir):
    """Functions that the settings forbid, by the first mention on a line."""
    line = F.element_at(F.array(*map(F.lit, CODE)), (F.col("ln") % 10 + 1).cast("int"))
    vendor = F.when(F.col("half") == 1, "src/").otherwise("vendor/")
    rows = document_lines(spark, sf_dir).select("doc_id", "ln", line.alias("line"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    rows = rows.select(F.concat(vendor, F.col("doc_id").cast("string"), F.lit(".php")).alias("path"), "ln", F.lit("Php").alias("lang"), "line")
    return detectors.forbidden_calls(rows, ["md5", "sha1"]).groupBy(F.regexp_extract("message", r"(\w+)\(", 1).alias("name")).agg(F.count("*").alias("n"))


RUST = ("pub fn handle_packet(x: u8) {", "    let b = buf.to_vec();", "    unsafe { x() }", "}", "fn cold() {", "    value.unwrap();", "    // SAFETY: checked", "    unsafe { y() }", "}", "let (tx, rx) = mpsc::channel();")


@_r.add(
    f"""WITH l AS (SELECT doc_id, ln, ln % 10 AS k FROM ({LINES_SQL})), p AS (SELECT doc_id, count(*) FILTER (k = 6) AS cold FROM l GROUP BY doc_id)
    SELECT * FROM (SELECT 'HotPathAllocation' AS kind, 'Info' AS severity, count(*) FILTER (k = 2) AS n FROM l UNION ALL SELECT 'UnsafeUsage', 'Info', count(*) FILTER (k IN (3, 8)) FROM l
      UNION ALL SELECT 'MissingSafetyComment', 'Low', count(*) FILTER (k = 3) FROM l UNION ALL SELECT 'PanicRisk', 'Info', sum(least(cold, 5) + (cold > 5)::INT)::BIGINT FROM p) WHERE n > 0"""
)
def rust_lines(spark, sf_dir):
    """Rust rules by the function around a line, with a cap per file."""
    line = F.element_at(F.array(*map(F.lit, RUST)), F.when(F.col("ln") % 10 == 0, 10).otherwise(F.col("ln") % 10).cast("int"))
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".rs"))
    rows = document_lines(spark, sf_dir).select(path.alias("path"), "ln", F.lit("Rust").alias("lang"), line.alias("line"))
    return detectors.rust(rows).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@_r.add(
    r"""WITH d AS (SELECT doc_id, md5(text) AS h1, md5(regexp_replace(lower(text), '[0-9\s]+', '', 'g')) AS h2 FROM documents WHERE text IS NOT NULL),
    e AS (SELECT *, count(*) OVER (PARTITION BY h1) AS n1 FROM d),
    r AS (SELECT *, count(*) OVER (PARTITION BY h2) AS n2 FROM e WHERE n1 = 1)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h1) AS canonical, 1 AS level, n1 AS members FROM e WHERE n1 > 1
    UNION ALL SELECT doc_id, min(doc_id) OVER (PARTITION BY h2), 2, n2 FROM r WHERE n2 > 1"""
)
def duplicate_cascade(spark, sf_dir):
    """A5: exact copies first, then copies up to case, digits and white space."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    levels = [F.md5("text"), F.md5(F.regexp_replace(F.lower("text"), r"[0-9\s]+", ""))]
    return A.duplicate_cascade(docs, "doc_id", levels)


@_r.add(
    r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS s FROM pages)
    SELECT CAST(page_id AS VARCHAR) || '.html' AS path, unnest(regexp_extract_all(s, '([A-Za-z_$][A-Za-z0-9_]*)\s*\(', 1)) AS callee_name FROM s"""
)
def inline_scripts(spark, sf_dir):
    """Calls in the inline scripts of pages."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("JavaScript").alias("lang"), F.col("html").alias("text"))
    return X.relation(X.extract(files), "call").select("path", "callee_name")


@_r.add(
    r"""WITH n AS (SELECT c_name AS name FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT s_name FROM supplier),
    w AS (SELECT name, list_filter(string_split_regex(regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '([^_])([A-Z])', '\1_\2', 'g'), '_'), lambda x: x <> '') AS ws FROM n)
    SELECT name, array_to_string(list_transform(ws, lambda x: lower(x)), '_') AS snake, array_to_string(list_transform(ws, lambda x: upper(x)), '_') AS screaming,
    array_to_string(list_transform(ws, lambda x: upper(x[1]) || lower(x[2:])), '') AS pascal FROM w"""
)
def naming_conventions(spark, sf_dir):
    """2.11 case family: names in snake, screaming and Pascal case."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionAll(table(spark, sf_dir, "part").select("p_name")).unionAll(table(spark, sf_dir, "supplier").select("s_name"))
    n = F.regexp_replace("name", "[^A-Za-z0-9]+", "_")
    return names.select("name", S.to_snake(n).alias("snake"), S.to_screaming(n).alias("screaming"), S.to_pascal(n).alias("pascal"))


@_r.add(
    r"""SELECT DISTINCT url, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^[^?#]*', 0), '^/+', ''), '/+$', ''), '/'),
    lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') OR s LIKE '{%' OR s LIKE ':%' OR contains(s, '${') THEN '*' ELSE s END), '/') AS pattern FROM pages"""
)
def url_patterns(spark, sf_dir):
    """2.11 URL family: route patterns of page addresses."""
    return table(spark, sf_dir, "pages").select("url", S.path_pattern(F.regexp_replace("url", "^[a-z]+://[^/]*", "")).alias("pattern")).distinct()


@_r.add(
    r"""WITH v AS (SELECT p_partkey, CAST(p_size % 3 AS BIGINT) AS a, CAST(p_partkey % 7 AS BIGINT) AS b, CAST(p_partkey % 11 AS BIGINT) AS c FROM part),
    k AS (SELECT 0 AS pa, 4 AS pb, 5 AS pc UNION ALL SELECT 1, 6, 0 UNION ALL SELECT 2, 3, 1)
    SELECT p_partkey, pa AS patched_major FROM v JOIN k ON CASE WHEN pa = 0 THEN a = 0 AND b = pb ELSE a = pa END AND (a, b, c) < (pa, pb, pc)"""
)
def advisory_match(spark, sf_dir):
    """Versions below the patched one on their compatibility line."""
    v = table(spark, sf_dir, "part").select("p_partkey", S.version(F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 11).cast("string"))).alias("version"))
    patched = F.array(*[S.version(F.lit(x)) for x in ("0.4.5", "1.6.0", "2.3.1")])
    return v.withColumn("patched", F.explode(patched)).filter(S.affected(F.col("version"), F.col("patched"))).select("p_partkey", F.col("patched.major").cast("int").alias("patched_major"))
