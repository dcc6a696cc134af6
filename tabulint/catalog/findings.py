"""The finding algebra over findings made from the events and documents tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulint.catalog.registry import Registry, table
from tabulint.operators import aggregates as A
from tabulint.operators import findings as P

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

# kinds and severities dealt out over events by id, so that every rule has rows
KINDS = ("SqlInjection", "MissingAuthMiddleware", "VulnerableDependency", "OversizedDatagram", "DuplicateDependency", "NPlusOneQuery", "MissingHookDependencies", "RunningAsRoot", "DeadFunction", "ExactDuplicate", "ConventionViolation", "LongFunction", "PanicRisk", "ParseFailure", "DangerousChain")
KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
SEVERITY_SQL = "['Critical', 'High', 'Medium', 'Low', 'Info']"
PATHS = ("src/main.py", "tests/unit/a.py", "vendor/lib.js", "tests/fixtures/b.php", "app/test_c.py", "public/x.min.js", "lib/core/d.rs", "conftest.py")
FINDINGS_SQL = f"""f AS (SELECT event_id AS id, {KINDS_SQL}[event_id % 15 + 1] AS kind, {SEVERITY_SQL}[event_id // 15 % 5 + 1] AS severity, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
    event_id % 7 = 0 AS auto_fixable, [{", ".join(f"'{p}'" for p in PATHS)}][event_id % 8 + 1] AS file, event_id // 40 AS line, event_type AS symbol, 'found ' || (event_id % 13) || ' in ' || event_type AS message FROM events)"""


def findings(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        k.alias("id"),
        pick(KINDS, k % 15).alias("kind"),
        pick(P.SEVERITIES, F.floor(k / 15) % 5).alias("severity"),
        ((k % 100).cast("double") / 100).alias("confidence"),
        (k % 7 == 0).alias("auto_fixable"),
        pick(PATHS, k % 8).alias("file"),
        F.floor(k / 40).alias("line"),
        F.col("event_type").alias("symbol"),
        F.concat(F.lit("found "), (k % 13).cast("string"), F.lit(" in "), "event_type").alias("message"),
    )


AUX_SQL = """NOT contains(file, 'tests/fixtures') AND (len(list_intersect(string_split(file, '/'), ['test', 'tests', 'vendor', 'public'])) > 0
    OR contains(file, '_test.') OR contains(file, '.min.js'))"""


@_r.add(f"WITH {FINDINGS_SQL} SELECT id FROM f WHERE NOT ({AUX_SQL}) OR kind IN ('RunningAsRoot', 'ParseFailure')")
def shipped_findings(spark, sf_dir):
    """Findings outside auxiliary paths."""
    return P.shipped(findings(spark, sf_dir)).select("id")


@_r.add(f"WITH {FINDINGS_SQL} SELECT id FROM f QUALIFY row_number() OVER (PARTITION BY kind, file, line ORDER BY id) = 1")
def deduplicated_findings(spark, sf_dir):
    """The first finding of a kind on a line."""
    return P.first_wins(findings(spark, sf_dir), ["kind", "file", "line"], ["id"]).select("id")


@_r.add(
    f"""WITH {FINDINGS_SQL}, m AS (SELECT id, concat_ws('|', kind, file, symbol, trim(regexp_replace(message, '[0-9]', '', 'g'))) AS m FROM f)
    SELECT id, md5(concat_ws('|', m, CAST(row_number() OVER (PARTITION BY m ORDER BY id) - 1 AS VARCHAR))) AS fingerprint FROM m"""
)
def finding_fingerprints(spark, sf_dir):
    """Fingerprints that stay when numbers in messages change."""
    return P.fingerprints(findings(spark, sf_dir), ["id"], hashed=F.md5).select("id", "fingerprint")


def _points(kinds, by) -> str:
    inside = ", ".join(f"'{k}'" for k in kinds)
    cases = " ".join(f"WHEN '{s}' THEN {p}" for s, p in zip(P.SEVERITIES, by))
    return f"CASE WHEN kind IN ({inside}) THEN CASE severity {cases} END ELSE 0 END"


def _score_sql(where: str, symbols: int) -> str:
    sums = ", ".join(f"coalesce(sum({' + '.join(_points(*r) for r in rules)}), 0) AS p_{d}" for d, rules in P.PENALTIES.items())
    dens = ", ".join(f"round(least(count(*) FILTER (kind IN ({', '.join(repr(k) for k in kinds)})) / greatest({symbols}, 100) / 0.1 * {most}, {most})) AS d{i}" for i, (_, kinds, most) in enumerate(P.DENSITIES))
    calm = ", ".join(repr(k) for k in P.INFORMATIONAL)
    return f"""p AS (SELECT {sums}, {dens}, count(*) FILTER (severity = 'Critical' AND kind NOT IN ({calm})) AS nc, count(*) FILTER (severity = 'High' AND kind NOT IN ({calm})) AS nh FROM f WHERE {where}),
    s AS (SELECT CAST(greatest(0, 100 - p_security) AS INTEGER) AS security, CAST(greatest(0, 100 - p_architecture - d0 - d1) AS INTEGER) AS architecture, CAST(greatest(0, 100 - p_performance) AS INTEGER) AS performance,
      CAST(greatest(0, 100 - d2) AS INTEGER) AS naming, CAST(greatest(0, 100 - d3) AS INTEGER) AS complexity, CAST(greatest(0, 100 - p_infrastructure) AS INTEGER) AS infrastructure, nc, nh FROM p),
    o AS (SELECT security, architecture, performance, naming, complexity, infrastructure, 0 AS test_coverage,
      CAST(least(floor(round((security * 0.25 + architecture * 0.15 + performance * 0.10 + naming * 0.08 + complexity * 0.10 + infrastructure * 0.12) / 0.80, 6)), CASE WHEN nc > 0 THEN 79 WHEN nh > 0 THEN 89 ELSE 100 END) AS INTEGER) AS overall, nc FROM s)"""


@_r.add(f"WITH {FINDINGS_SQL}, {_score_sql('true', 5000)} SELECT * EXCLUDE (nc) FROM o")
def score_all(spark, sf_dir):
    """The score of all findings."""
    return P.score(findings(spark, sf_dir), 5000)


@_r.add(f"WITH {FINDINGS_SQL} SELECT CASE WHEN auto_fixable AND confidence >= 0.85 THEN 'auto_fix' WHEN confidence >= 0.5 THEN 'ai_review' ELSE 'human' END AS route, count(*) AS n FROM f GROUP BY ALL")
def triage_counts(spark, sf_dir):
    """What goes to automatic fixing, review or a person."""
    return P.triage(findings(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"))


@_r.add(f"WITH {FINDINGS_SQL}, {_score_sql('true', 5000)} SELECT overall >= 85 AND security >= 90 AND c <= 0 AS passed, overall, security, c AS critical FROM o, (SELECT count(*) AS c FROM f WHERE severity = 'Critical' AND kind <> 'DangerousChain')")
def deploy_gate(spark, sf_dir):
    """The deploy gate."""
    every = findings(spark, sf_dir)
    return P.deploy_gate(P.score(every, 5000), every, files=1)


@_r.add(
    f"""WITH {FINDINGS_SQL} SELECT id, severity IN ('Critical', 'High') AS fails FROM f WHERE severity <> 'Info' AND kind <> 'DangerousChain'
    ORDER BY list_position({SEVERITY_SQL}, severity), file, line, kind, message, id LIMIT 100"""
)
def verdict_top(spark, sf_dir):
    """The 100 worst findings of a verdict (a report's limit)."""
    v = P.verdict(findings(spark, sf_dir))
    return v.orderBy(P.severity_rank(F.col("severity")).desc(), "file", "line", "kind", "message", "id").limit(100).select("id", "fails")


@_r.add(f"WITH {FINDINGS_SQL} SELECT kind, severity, count(*) AS n, round(avg(confidence), 6) AS confidence FROM f GROUP BY ALL")
def kind_counts(spark, sf_dir):
    """Exact totals by kind and severity."""
    return findings(spark, sf_dir).groupBy("kind", "severity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@_r.add(
    """WITH s AS (SELECT o_orderkey AS symbol_id, CASE WHEN o_orderkey % 10 = 0 THEN 'Class' WHEN o_orderkey % 2 = 0 THEN 'Method' ELSE 'Function' END AS kind, CAST(o_custkey AS BIGINT) * 10 AS parent_id,
      1 AS line_start, CAST(o_totalprice / 2000 AS INTEGER) AS line_end, CAST(o_orderkey % 8 AS INTEGER) AS param_count FROM orders)
    SELECT symbol_id, 'LongFunction' AS finding, CAST(line_end AS BIGINT) AS value FROM s WHERE kind <> 'Class' AND line_end > 50
    UNION ALL SELECT symbol_id, 'TooManyParams', CAST(param_count AS BIGINT) FROM s WHERE kind <> 'Class' AND param_count > 5
    UNION ALL SELECT c.symbol_id, 'GodClass', n FROM (SELECT parent_id AS pid, count(*) AS n FROM s WHERE kind = 'Method' GROUP BY 1 HAVING count(*) > 6) JOIN s c ON c.symbol_id = pid AND c.kind = 'Class'"""
)
def complexity_findings(spark, sf_dir):
    """A3, A4: long functions, many parameters, classes of many methods."""
    k = F.col("o_orderkey")
    # a cast in SQL takes halves to the even number
    s = table(spark, sf_dir, "orders").select(
        k.alias("symbol_id"), F.when(k % 10 == 0, "Class").when(k % 2 == 0, "Method").otherwise("Function").alias("kind"), (F.col("o_custkey") * 10).alias("parent_id"),
        F.lit(1).alias("line_start"), F.rint(F.col("o_totalprice") / 2000).cast("int").alias("line_end"), (k % 8).cast("int").alias("param_count"),
    )
    return A.complexity(s, methods=6)


@_r.add(
    """WITH c AS (SELECT CASE WHEN event_id % 5 < 2 THEN 'Resolved' WHEN event_id % 5 = 4 THEN 'Dynamic' ELSE 'Unresolved' END AS k, event_type AS root FROM events)
    SELECT sum((k = 'Resolved')::INT)::BIGINT AS resolved, sum((k = 'Unresolved' AND root IN ('click', 'view'))::INT)::BIGINT AS in_tree, sum((k = 'Unresolved' AND root NOT IN ('click', 'view'))::INT)::BIGINT AS external,
    sum((k = 'Dynamic')::INT)::BIGINT AS dynamic, round(sum((k = 'Resolved')::INT) / (sum((k = 'Resolved')::INT) + sum((k = 'Unresolved' AND root IN ('click', 'view'))::INT)), 2) AS rate FROM c"""
)
def resolution_rate(spark, sf_dir):
    """How many calls resolve."""
    k = F.col("event_id") % 5
    calls = table(spark, sf_dir, "events").select(F.when(k < 2, "Resolved").when(k == 4, "Dynamic").otherwise("Unresolved").alias("target_kind"), F.concat(F.col("event_type"), F.lit("::run")).alias("callee_name"))
    return A.resolution_stats(calls, spark.createDataFrame([("click",), ("view",)], "root string"))
