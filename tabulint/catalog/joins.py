"""Resolver, endpoints, spans, suppression, baselines, lookups, windows over the star schema and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulint.catalog.registry import Registry, table
from tabulint.functions import scalar as S
from tabulint.operators import aggregates as A
from tabulint.operators import joins as J

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


@_r.add(
    r"""WITH s AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS low, regexp_extract(p_name, '([^ ]*)$', 1) AS last, p_size % 5 AS grp FROM part),
    c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, CASE l_linenumber % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN 'x ' || p_name ELSE p_name || '?' END AS name, CAST(l_orderkey % 5 AS INTEGER) AS grp
      FROM lineitem JOIN part ON p_partkey = l_partkey),
    q AS (SELECT DISTINCT name, grp FROM c),
    t0 AS (SELECT q.name, q.grp, count(*) AS n, min(id) AS a, sum((s.grp = q.grp)::INT) AS nl, min(CASE WHEN s.grp = q.grp THEN id END) AS b FROM q JOIN s ON q.name = s.name GROUP BY ALL),
    t1 AS (SELECT q.name, q.grp, count(*) AS n, min(id) AS a, sum((s.grp = q.grp)::INT) AS nl, min(CASE WHEN s.grp = q.grp THEN id END) AS b FROM q JOIN s ON lower(q.name) = s.low GROUP BY ALL),
    t2 AS (SELECT q.name, q.grp, count(*) AS n, min(id) AS a, sum((s.grp = q.grp)::INT) AS nl, min(CASE WHEN s.grp = q.grp THEN id END) AS b FROM q JOIN s ON regexp_extract(q.name, '([^ ]*)$', 1) = s.last GROUP BY ALL),
    d AS (SELECT q.name, q.grp,
      CASE WHEN t0.n = 1 THEN t0.a WHEN t0.nl = 1 THEN t0.b END AS x0, CASE WHEN t1.n = 1 THEN t1.a WHEN t1.nl = 1 THEN t1.b END AS x1, CASE WHEN t2.n = 1 THEN t2.a WHEN t2.nl = 1 THEN t2.b END AS x2
      FROM q LEFT JOIN t0 USING (name, grp) LEFT JOIN t1 USING (name, grp) LEFT JOIN t2 USING (name, grp))
    SELECT call_id, coalesce(x0, x1, x2) AS target, CASE WHEN x0 IS NOT NULL THEN 0 WHEN x1 IS NOT NULL THEN 1 WHEN x2 IS NOT NULL THEN 2 END AS tier FROM c JOIN d USING (name, grp)"""
)
def resolver_cascade(spark, sf_dir):
    """Names resolved by the exact name, then in any case, then by the last
    word, each time if one symbol or one of the caller's group has it."""
    part = table(spark, sf_dir, "part")
    symbols = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("full"), (F.col("p_size") % 5).alias("group"))
    item = table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    k = F.col("l_linenumber") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).when(k == 2, F.concat(F.lit("x "), "p_name")).otherwise(F.concat("p_name", F.lit("?")))
    calls = item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), name.alias("name"), (F.col("l_orderkey") % 5).cast("int").alias("group"))
    word = lambda c: F.regexp_extract(F.col(c), "([^ ]*)$", 1)
    tiers = [(F.col("name"), F.col("full")), (F.lower("name"), F.lower("full")), (word("name"), word("full"))]
    return J.resolve(calls, symbols, tiers, []).select("call_id", "target", "tier")


ROUTES_SQL = r"""
  r AS (SELECT page_id AS route_seq, CASE page_id % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'get' ELSE 'post' END AS verb, CASE WHEN page_id % 3 = 0 THEN '/api/v1' ELSE '' END || '/' || url_path AS path FROM (
    SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^[^?#]*', 0), '^/+|/+$', '', 'g') AS url_path FROM pages)),
  c AS (SELECT page_id * 10 AS call_seq, CASE page_id % 3 WHEN 0 THEN 'get' ELSE 'post' END AS verb, CASE WHEN page_id % 5 = 0 THEN '/api' ELSE '' END || '/' || url_path AS path FROM (
    SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^[^?#]*', 0), '^/+|/+$', '', 'g') AS url_path FROM pages)),
  pat AS (SELECT DISTINCT path, array_to_string(list_transform(string_split(regexp_replace(path, '^/+|/+$', '', 'g'), '/'), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '*' ELSE s END), '/') AS p FROM (SELECT path FROM r UNION SELECT path FROM c)),
  dep AS (SELECT path, p, CASE WHEN p LIKE 'api/%' THEN CASE WHEN regexp_matches(p[5:], '^v[0-9]+$') THEN '' ELSE regexp_replace(p[5:], '^v[0-9]+/', '') END ELSE p END AS d FROM pat),
  rr AS (SELECT r.*, p, d FROM r JOIN dep USING (path)), cc AS (SELECT c.*, p, d FROM c JOIN dep USING (path)),
  m AS (SELECT call_seq, 0 AS tier, route_seq FROM cc JOIN rr ON cc.p = rr.p AND (cc.verb = rr.verb OR rr.verb = 'any' OR cc.verb = 'any')
    UNION ALL SELECT call_seq, 1, route_seq FROM cc JOIN rr ON cc.d = rr.d AND cc.d <> '' AND (cc.verb = rr.verb OR rr.verb = 'any' OR cc.verb = 'any')),
  b AS (SELECT call_seq, tier, route_seq FROM (SELECT *, row_number() OVER (PARTITION BY call_seq ORDER BY tier, route_seq) AS rn FROM m) WHERE rn = 1)
"""


def routes_and_calls(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Page addresses as routes and, with other verbs and prefixes, as calls."""
    path = F.regexp_replace(F.regexp_extract(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), r"^[^?#]*", 0), r"^/+|/+$", "")
    pages, k = table(spark, sf_dir, "pages").withColumn("p", path), F.col("page_id")
    verb = F.when(k % 4 == 0, "any").when(k % 4 == 1, "get").otherwise("post")
    routes = pages.select(k.alias("route_seq"), verb.alias("verb"), F.concat(F.when(k % 3 == 0, "/api/v1").otherwise(""), F.lit("/"), "p").alias("path"))
    calls = pages.select((k * 10).alias("call_seq"), F.when(k % 3 == 0, "get").otherwise("post").alias("verb"), F.concat(F.when(k % 5 == 0, "/api").otherwise(""), F.lit("/"), "p").alias("path"))
    return routes, calls


@_r.add(f"WITH {ROUTES_SQL} SELECT c.call_seq, b.route_seq, CASE b.tier WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' END AS \"match\" FROM c LEFT JOIN b USING (call_seq)")
def endpoint_links(spark, sf_dir):
    """The first route in order that serves a client call."""
    routes, calls = routes_and_calls(spark, sf_dir)
    return J.link_endpoints(calls, routes).select("call_seq", "route_seq", "match")


@_r.add(
    f"""WITH {ROUTES_SQL} SELECT (SELECT count(*) FROM b) AS matched, (SELECT count(*) FROM c WHERE call_seq NOT IN (SELECT call_seq FROM b)) AS orphan_calls,
    (SELECT count(*) FROM r WHERE route_seq NOT IN (SELECT route_seq FROM b)) AS orphan_routes"""
)
def endpoint_reconcile(spark, sf_dir):
    """Matched calls, calls without a route, routes without a call."""
    routes, calls = routes_and_calls(spark, sf_dir)
    return J.reconcile(calls, routes)["counts"]


@_r.add(
    f"""WITH {ROUTES_SQL}, k AS (SELECT route_seq, unnest(CASE WHEN verb = 'any' THEN ['get', 'post', 'put', 'patch', 'delete'] ELSE [verb] END) || ' ' || p AS key FROM rr)
    SELECT verb || ' ' || p AS key, count(*) AS n FROM cc WHERE verb || ' ' || p NOT IN (SELECT key FROM k) GROUP BY ALL"""
)
def endpoint_view_orphans(spark, sf_dir):
    """Calls whose `verb pattern` no route has; here no prefix is tolerated."""
    routes, calls = routes_and_calls(spark, sf_dir)
    asked = calls.select(F.concat_ws(" ", "verb", S.path_pattern(F.col("path"))).alias("key"))
    return asked.join(J.endpoint_keys(routes), "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"))


@_r.add(
    """WITH s AS (SELECT o_orderkey AS id, o_custkey % 50 AS g, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS a, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + o_orderkey % 40 - 5 AS z FROM orders),
    p AS (SELECT l_orderkey * 10 + l_linenumber AS pid, l_suppkey % 50 AS g, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS t FROM lineitem)
    SELECT pid, t, span FROM (SELECT p.pid, p.t, s.id AS span, row_number() OVER (PARTITION BY p.pid, p.g, p.t ORDER BY z - a, a, z, s.id) AS rn FROM p LEFT JOIN s ON s.g = p.g AND t BETWEEN a AND z) WHERE rn = 1"""
)
def enclosing_spans(spark, sf_dir):
    """The narrowest span around each point."""
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 86400)
    start = day("o_orderdate")
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("g"), start.alias("a"), (start + F.col("o_orderkey") % 40 - 5).alias("z"))
    points = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"), (F.col("l_suppkey") % 50).alias("g"), day("l_shipdate").alias("t"))
    return J.enclosing(points, spans, "g", "t", "a", "z", "id", 16).select("pid", "t", "span")


def _turns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line"), F.col("role").alias("kind"))
    sites = turns.filter("(file + line) % 3 = 0").select("file", F.col("line").alias("ln"), F.when(F.col("file") % 2 == 0, F.array(F.lit("user"))).alias("kinds"))
    return turns, sites


TURNS_SQL = """t AS (SELECT conv_id AS file, turn + 1 AS line, role AS kind FROM conversations),
    s AS (SELECT file, line AS ln, file % 2 = 0 AS only_user FROM t WHERE (file + line) % 3 = 0),
    u AS (SELECT t.file, t.line, t.kind, s.ln FROM t JOIN s ON t.file = s.file AND (t.line = s.ln OR t.line = s.ln + 1) AND t.line > 0 AND (NOT only_user OR kind = 'user'))"""


@_r.add(f"WITH {TURNS_SQL} SELECT file, line, kind FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.file = t.file AND u.line = t.line AND u.kind = t.kind)")
def suppression_kept(spark, sf_dir):
    """Findings that no suppression covers."""
    return J.suppress(*_turns(spark, sf_dir))[0]


@_r.add(f"WITH {TURNS_SQL} SELECT s.file, s.ln FROM s WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.file = s.file AND u.ln = s.ln)")
def suppression_stale(spark, sf_dir):
    """Suppressions that cover nothing."""
    return J.suppress(*_turns(spark, sf_dir))[2].select("file", "ln")


BASE_SQL = """c AS (SELECT doc_id, md5(concat_ws('|', source, lang, CAST(n_chars % 97 AS VARCHAR))) AS fingerprint, source <> 'src0' AS ok FROM documents WHERE doc_id % 2 = 0),
    b AS (SELECT DISTINCT md5(concat_ws('|', source, lang, CAST(n_chars % 97 AS VARCHAR))) AS fingerprint FROM documents WHERE doc_id % 2 = 1)"""


@_r.add(
    f"""WITH {BASE_SQL} SELECT (SELECT count(*) FROM c WHERE ok AND fingerprint NOT IN (SELECT fingerprint FROM b)) AS n_new, (SELECT count(*) FROM c WHERE ok AND fingerprint IN (SELECT fingerprint FROM b)) AS n_existing,
    (SELECT count(*) FROM b WHERE fingerprint NOT IN (SELECT fingerprint FROM c)) AS n_resolved"""
)
def baseline_counts(spark, sf_dir):
    """New, existing and resolved findings against a baseline."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.concat_ws("|", "source", "lang", (F.col("n_chars") % 97).cast("string"))).alias("fingerprint"))
    parts = J.baseline_diff(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1").select("fingerprint").distinct(), F.col("source") != "src0")
    out = parts["new"].agg(F.count("*").alias("n_new"))
    for k in ("existing", "resolved"):
        out = out.join(F.broadcast(parts[k].agg(F.count("*").alias(f"n_{k}"))))
    return out


LOOKED_UP = ("small gizmo", "GIZMO", "lt")


@_r.add(
    f"""WITH q AS (SELECT unnest([{", ".join(f"'{x}'" for x in LOOKED_UP)}]) AS q), s AS (SELECT p_partkey, p_name, regexp_extract(p_name, '([^ ]*)$', 1) AS short FROM part),
    t AS (SELECT q, p_partkey, CASE WHEN p_name = q THEN 0 WHEN short = q THEN 1 WHEN contains(lower(p_name), lower(q)) THEN 2 END AS tier FROM s, q)
    SELECT q AS query, p_partkey, tier FROM t WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY q)"""
)
def symbol_lookup(spark, sf_dir):
    """Names by the whole name, else by a part of it in any case."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.substring_index("p_name", " ", -1).alias("short"))
    found = [J.lookup(parts, q, full="p_name", name="short").select(F.lit(q).alias("query"), "p_partkey", "tier") for q in LOOKED_UP]
    return found[0].unionAll(found[1]).unionAll(found[2])


@_r.add(
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS cls, 'm' || (c_custkey % 40) AS name FROM customer),
    m AS (SELECT cls, name, min(k) AS id, count(*) AS n FROM c GROUP BY ALL),
    q AS (SELECT o_orderkey AS call_id, c_nationkey AS cls, 'm' || (o_orderkey % 40) AS name, o_orderkey % 2 = 0 AS own FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT call_id, CASE WHEN m.n = 1 THEN m.id END AS target FROM q LEFT JOIN m ON m.name = q.name AND m.cls = CASE WHEN own THEN q.cls ELSE (q.cls + 1) % 25 END"""
)
def method_resolution(spark, sf_dir):
    """Methods by the class around a call, and by a class that the call names."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    text = lambda c: F.col(c).cast("string")
    classes = nation.select(F.concat(F.lit("K"), text("n_nationkey")).alias("id"), F.concat(F.lit("K"), text("n_nationkey")).alias("name"), F.concat(F.lit("app::K"), text("n_nationkey")).alias("full_name"), F.lit("Class").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit("a").alias("group"), F.lit(1).alias("line_start"))
    method = F.concat(F.lit("m"), (F.col("c_custkey") % 40).cast("string"))
    own = F.concat(F.lit("K"), text("c_nationkey"))
    methods = customer.select(text("c_custkey").alias("id"), method.alias("name"), F.concat(F.lit("app::"), own, F.lit("::"), method, F.lit("#"), text("c_custkey")).alias("full_name"), F.lit("Method").alias("kind"), own.alias("parent_id"), text("c_custkey").alias("group"), F.lit(1).alias("line_start"))
    symbols, tiers = J.method_tiers(classes.unionAll(methods))
    name = F.concat(F.lit("m"), (F.col("o_orderkey") % 40).cast("string"))
    call = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("$this->"), name)).otherwise(F.concat(F.lit("K"), ((F.col("c_nationkey") + 1) % 25).cast("string"), F.lit("::"), name))
    calls = table(spark, sf_dir, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("call_id"), call.alias("name"), F.lit("z").alias("group"), own.alias("owner"))
    return J.resolve(calls, symbols, tiers[:2], ["group", "line_start"]).select("call_id", F.col("target").cast("long").alias("target"))


@_r.add(
    """WITH s AS (SELECT o_custkey AS g, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS a, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + o_orderkey % 90 AS z FROM orders),
    m AS (SELECT *, max(z) OVER (PARTITION BY g ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
    SELECT g, CAST(island AS BIGINT) AS island, min(a) AS a, max(z) AS z, count(*) AS spans FROM i GROUP BY g, island"""
)
def merged_spans(spark, sf_dir):
    """overlapping spans merged."""
    start = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), start.alias("a"), (start + F.col("o_orderkey") % 90).alias("z"))
    return J.deoverlapped(spans, "g", "a", "z")


@_r.add(
    """SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS section,
    CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN -1 ELSE 0 END) OVER w AS BIGINT) AS depth,
    max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 AS near
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def ordered_folds(spark, sf_dir):
    """Forward fill, running depth and a look-back frame."""
    e, order = table(spark, sf_dir, "events"), ["ts", "event_id"]
    e = A.forward_filled(e, "user_id", order, F.when(F.col("event_type") == "click", F.col("event_id")), "section")
    k = F.col("event_id") % 3
    e = A.running_depth(e, "user_id", order, F.when(k == 0, 1).when(k == 1, -1).otherwise(0))
    return A.near_flag(e, "user_id", order, F.col("event_type") == "purchase", 3, 0).select("event_id", "section", "depth", "near")


@_r.add(
    """WITH s AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'getItem' WHEN s_suppkey % 3 = 1 THEN 'fetchItem' ELSE 'createItem' END AS fn FROM supplier)
    SELECT 'read' AS "group", CASE WHEN fn = 'getItem' THEN 'get' ELSE 'fetch' END AS prefix, min_by(fn, id) AS "first", count(*) AS n FROM s WHERE fn <> 'createItem' GROUP BY ALL"""
)
def prefix_inconsistency(spark, sf_dir):
    """Synonym prefixes used side by side."""
    k = F.col("s_suppkey") % 3
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(k == 0, "getItem").when(k == 1, "fetchItem").otherwise("createItem").alias("fn"))
    return A.prefix_variants(s, {"read": ("get", "fetch", "retrieve"), "write": ("create", "make")}, "fn", ["id"])
