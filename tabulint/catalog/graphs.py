"""Graph operators over trade between nations and parts of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulint.catalog.registry import Registry, table
from tabulint.operators import chains
from tabulint.operators import graph as G

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

# every line item is an edge from the customer's nation to the supplier's
TRADE_SQL = """t AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""
# customers and suppliers lead to their nation, nations to their region, and a region to its customers in debt
TIES_SQL = """e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0),
    v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""


def trade(spark, sf_dir) -> DataFrame:
    item, orders, customer, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = item.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return j.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))


def _name(letter: str, key: str):
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def ties(spark, sf_dir) -> DataFrame:
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    debt = customer.filter("c_acctbal < 0").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    out = customer.select(_name("c", "c_custkey").alias("src"), _name("n", "c_nationkey").alias("dst"))
    out = out.unionAll(supplier.select(_name("s", "s_suppkey"), _name("n", "s_nationkey"))).unionAll(nation.select(_name("n", "n_nationkey"), _name("r", "n_regionkey")))
    return out.unionAll(debt.select(_name("r", "n_regionkey"), _name("c", "c_custkey")))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def code(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The same graph as symbols and calls: customers of one segment are entry points,
    suppliers tests; regions call what is dangerous, every third nation a gate."""
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    where = nation.join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    own = lambda df, letter, key, path, entry: df.select(_name(letter, key).alias("id"), _name(letter, key).alias("name"), F.concat(F.lit("app::"), _name(letter, key)).alias("full_name"), path.alias("path"), entry.alias("is_entry_point"))
    no = F.lit(False)
    symbols = own(customer.join(where, F.col("n_nationkey") == F.col("c_nationkey")), "c", "c_custkey", F.concat(F.lit("src/"), F.lower(F.regexp_replace("r_name", " ", "_")), F.lit(".py")), F.col("c_mktsegment") == "BUILDING")
    symbols = symbols.unionAll(own(supplier, "s", "s_suppkey", F.lit("tests/unit/a.py"), no)).unionAll(own(nation, "n", "n_nationkey", F.lit("src/nation.py"), no))
    symbols = symbols.unionAll(own(table(spark, sf_dir, "region"), "r", "r_regionkey", F.when(F.col("r_regionkey") == 1, "src/admin.py").otherwise("src/region.py"), no))
    symbols = symbols.withColumns({"kind": F.lit("Function"), "lang": F.lit("Python"), "line_start": F.lit(1)})
    call = lambda df, caller, callee, name, kind: df.select(caller.alias("caller_id"), callee.cast("string").alias("callee_id"), name.alias("callee_name"), F.lit(kind).alias("target_kind"), F.lit("src/x.py").alias("path"), F.lit(1).alias("line_start"))
    calls = call(ties(spark, sf_dir), F.col("src"), F.col("dst"), F.col("dst"), "Resolved")
    sinks = F.element_at(F.array(*map(F.lit, ("eval", "db.delete", "unlink", "whereRaw", "readfile"))), (F.col("r_regionkey") + 1).cast("int"))
    calls = calls.unionAll(call(table(spark, sf_dir, "region"), _name("r", "r_regionkey"), F.lit(None), sinks, "Unresolved"))
    return symbols, calls.unionAll(call(nation.filter("n_nationkey % 3 = 0"), _name("n", "n_nationkey"), F.lit(None), F.lit("user.authorize"), "Unresolved"))


@_r.add(f"WITH {TRADE_SQL} SELECT src, dst, count(*) AS weight FROM t WHERE src <> dst GROUP BY ALL ORDER BY weight DESC, src, dst LIMIT 10")
def heaviest_edges(spark, sf_dir):
    """The ten heaviest module edges (a report's limit)."""
    return G.heaviest(trade(spark, sf_dir), 10)


@_r.add(
    f"""WITH {TIES_SQL}, d AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), n AS (SELECT src AS node, 0 AS i, 1 AS o FROM d UNION ALL SELECT dst, 1, 0 FROM d)
    SELECT node, sum(i)::BIGINT AS ca, sum(o)::BIGINT AS ce, sum(o) / (sum(i) + sum(o)) AS instability FROM n GROUP BY node"""
)
def module_coupling(spark, sf_dir):
    """Couplings and instability."""
    return G.coupling(ties(spark, sf_dir))


@_r.add(f"WITH RECURSIVE {TIES_SQL}, r(node, depth) AS (SELECT 'c1', 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 12) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def reachable_nodes(spark, sf_dir):
    """Breadth-first reach from a seed."""
    return G.reachable(spark.createDataFrame([("c1",)], "node string"), ties(spark, sf_dir))


@_r.add(f"WITH RECURSIVE {TIES_SQL}, r(node, depth) AS (SELECT 'n3', 0 UNION SELECT src, depth + 1 FROM r JOIN e ON dst = node WHERE depth < 12) SELECT node, min(depth) AS depth FROM r GROUP BY node HAVING min(depth) > 0")
def impacted_nodes(spark, sf_dir):
    """Everything that leads to a node."""
    return G.impact(spark.createDataFrame([("n3",)], "node string"), ties(spark, sf_dir))


@_r.add(
    """WITH c AS (SELECT 'c' || c_custkey AS entry, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'),
    s AS (SELECT * FROM (VALUES (0, 'Exec', 'eval', 'Critical'), (1, 'Deletion', 'delete', 'High'), (2, 'Deletion', 'unlink', 'High'), (3, 'Sql', 'whereRaw', 'Critical'), (4, 'FileSystem', 'readfile', 'Medium')) AS t(r, sink, name, severity)),
    p AS (SELECT entry, sink, name, n % 3 = 0 AS gated, CASE WHEN n % 3 = 0 THEN 'Low' ELSE severity END AS base, r, 'app::' || entry || ' > app::n' || n || ' > app::r' || r AS way FROM c JOIN s USING (r))
    SELECT entry, sink, name, 3 AS depth, gated, CASE WHEN r = 1 THEN CASE base WHEN 'Low' THEN 'Medium' WHEN 'Medium' THEN 'High' ELSE 'Critical' END ELSE base END AS severity, way FROM p"""
)
def dangerous_chains(spark, sf_dir):
    """The shortest way from each entry point to each dangerous call, with gates and tiers."""
    return chains.chains(*code(spark, sf_dir), most_rows=None).withColumn("way", F.array_join("path", " > ")).drop("path")


def _rank_sql(rounds: int) -> str:
    steps = ["k0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM v, c)"]
    for i in range(rounds):
        steps.append(f"k{i + 1} AS (SELECT v.node, 0.15::DOUBLE / n + 0.85::DOUBLE * l.x / n + 0.85::DOUBLE * coalesce(g.x, 0) AS rank FROM v CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(rank), 0) AS x FROM k{i} WHERE node NOT IN (SELECT src FROM deg)) l LEFT JOIN (SELECT dst, sum(rank * w / deg.n) AS x FROM k{i} JOIN m ON src = node JOIN deg USING (src) GROUP BY dst) g ON g.dst = v.node)")
    return f"WITH {TIES_SQL}, m AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM e WHERE src <> dst GROUP BY ALL), deg AS MATERIALIZED (SELECT src, sum(w) AS n FROM m GROUP BY src), c AS (SELECT count(*) AS n FROM v), " + ", ".join(steps) + f" SELECT node, round(rank, 9) AS rank FROM k{rounds}"


@_r.add(_rank_sql(10))
def page_rank(spark, sf_dir):
    """PageRank after ten rounds; the tests compare sixty with a plain loop."""
    e = ties(spark, sf_dir)
    return G.pagerank(ends(e), e, rounds=10).withColumn("rank", F.round("rank", 9))


SCC_SQL = f"""{TIES_SQL}, r(a, b) AS (SELECT node, node FROM v UNION SELECT a, dst FROM r JOIN e ON src = b),
    c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = ties(spark, sf_dir)
    return G.strong_components(ends(e), e), e


@_r.add(f"WITH RECURSIVE {SCC_SQL} SELECT node, component FROM c")
def strong_components(spark, sf_dir):
    """Strongly connected components."""
    return _parts(spark, sf_dir)[0]


@_r.add(f"WITH RECURSIVE {SCC_SQL} SELECT component, count(*) AS size, list_sort(list(node)) AS members FROM c GROUP BY component HAVING count(*) > 1")
def module_cycles(spark, sf_dir):
    """Cycles between modules."""
    return G.cycles(_parts(spark, sf_dir)[0])


LAYER_SQL = f"""{SCC_SQL}, x AS (SELECT DISTINCT p.component AS a, q.component AS b FROM e JOIN c p ON p.node = src JOIN c q ON q.node = dst WHERE p.component <> q.component),
    l(component, layer) AS (SELECT DISTINCT component, 0 FROM c UNION SELECT b, layer + 1 FROM l JOIN x ON a = component)"""


@_r.add(f"WITH RECURSIVE {LAYER_SQL} SELECT component, max(layer) AS layer FROM l GROUP BY component")
def layering(spark, sf_dir):
    """Longest-path layers of the condensed graph."""
    return G.layers(*_parts(spark, sf_dir))


@_r.add(f"WITH RECURSIVE {LAYER_SQL} SELECT (SELECT max(layer) + 1 FROM l) AS depth, (SELECT count(*) FROM c) AS nodes, (SELECT count(*) FROM (SELECT component FROM c GROUP BY component HAVING count(*) > 1)) AS cycles")
def graph_summary(spark, sf_dir):
    """The whole analysis of a graph, as its depth, nodes and cycles."""
    e = ties(spark, sf_dir)
    got = G.analysed(ends(e), e)
    return got["depth"].join(got["components"].agg(F.count("*").alias("nodes"))).join(got["cycles"].agg(F.count("*").alias("cycles")))


@_r.add(
    """SELECT 'n' || n_nationkey AS node FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal >= 0 UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'r' || n_regionkey FROM nation GROUP BY n_regionkey HAVING count(*) > 1"""
)
def articulation_points(spark, sf_dir):
    """Nodes whose removal splits the graph: nations that someone hangs on alone, and
    regions of several nations."""
    return G.per_component(ties(spark, sf_dir), "articulation")


@_r.add()
def communities(spark, sf_dir):
    """Label propagation in node order; the tests compare with a plain loop."""
    return G.per_component(ties(spark, sf_dir), "community")


@_r.add(
    """SELECT event_type AS src, dst, count(*) AS weight FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY ALL"""
)
def state_transitions(spark, sf_dir):
    """Weighted edges between successive event types of a user."""
    return G.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").groupBy("src", "dst").agg(F.count("*").alias("weight"))
