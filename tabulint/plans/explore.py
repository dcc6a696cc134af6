"""Questions about an analysed tree, each a DataFrame: what an agent or a person asks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulint.operators import aggregates as A
from tabulint.operators import graph as G
from tabulint.operators import joins as J
from tabulint.operators.findings import severity_rank

# What a finding kind does to an objective, and how much.
IMPACTS = (
    ("BlockingInAsync", "Latency", "Hurts", 3), ("BlockingInAsync", "Throughput", "Hurts", 3), ("UnboundedChannel", "Latency", "Hurts", 2), ("UnboundedChannel", "Memory", "Hurts", 3), ("UnboundedChannel", "Throughput", "Helps", 1),
    ("HotPathAllocation", "Latency", "Hurts", 1), ("HotPathAllocation", "Throughput", "Hurts", 1), ("HotPathAllocation", "Memory", "Hurts", 1), ("LockOnHotPath", "Latency", "Hurts", 2), ("LockOnHotPath", "Throughput", "Hurts", 2),
    ("PanicRisk", "Reliability", "Hurts", 2), ("NPlusOneQuery", "Latency", "Hurts", 3), ("NPlusOneQuery", "Throughput", "Hurts", 2), ("OversizedDatagram", "Reliability", "Hurts", 2), ("SplitDatagramMessage", "Reliability", "Hurts", 3),
)


def definition_of(symbols: DataFrame, query: str, most: int = 20) -> DataFrame:
    return J.lookup(symbols, query).orderBy("path", "line_start", "name").limit(most)


def callers_of(symbols: DataFrame, calls: DataFrame, symbol_id: str) -> DataFrame:
    """(path, line, caller) of the calls that resolve to a symbol, in order."""
    to = calls.filter(F.col("callee_id") == symbol_id).select("path", F.col("line_start").alias("line"), F.col("caller_id").alias("id"))
    return to.join(symbols.select("id", F.col("full_name").alias("caller")), "id", "left").select("path", "line", "caller").orderBy("path", "line")


def callees_of(symbols: DataFrame, calls: DataFrame, symbol_id: str) -> DataFrame:
    """One row: sorted distinct names of resolved, unresolved and dynamic callees."""
    of = calls.filter(F.col("caller_id") == symbol_id).join(symbols.select(F.col("id").alias("callee_id"), "full_name"), "callee_id", "left")
    pick = lambda kind, name: F.array_sort(F.collect_set(F.when(F.col("target_kind") == kind, F.col(name)))).alias(kind.lower())
    return of.agg(pick("Resolved", "full_name"), pick("Unresolved", "callee_name"), pick("Dynamic", "callee_name"))


def references_of(symbols: DataFrame, calls: DataFrame, symbol_id: str, most: int = 100) -> DataFrame:
    """Calls that resolve to a symbol, and unresolved ones of its name."""
    name = symbols.filter(F.col("id") == symbol_id).select(F.col("name").alias("__n")).limit(1)
    last = F.regexp_extract("callee_name", r"([^\\:>.]*)$", 1)
    hit = calls.join(F.broadcast(name)).filter((F.col("callee_id") == symbol_id) | (F.col("callee_id").isNull() & (last == F.col("__n"))))
    return hit.select("path", F.col("line_start").alias("line"), "callee_name", F.col("callee_id").isNotNull().alias("resolved")).orderBy("path", "line", "callee_name").limit(most)


def impact_of(symbols: DataFrame, calls: DataFrame, symbol_id: str, most: int = 100) -> DataFrame:
    """Everything that calls a symbol over any number of steps."""
    edges = calls.filter("callee_id is not null and caller_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))
    hit = G.impact(symbols.filter(F.col("id") == symbol_id).select(F.col("id").alias("node")), edges)
    return hit.join(symbols.withColumnRenamed("id", "node"), "node").select("path", "line_start", "full_name", "depth").orderBy("path", "line_start", "full_name").limit(most)


def audit(findings: DataFrame, least: str | None = None, most: int = 100, changed: DataFrame | None = None) -> DataFrame:
    """The worst findings, of changed files (file) alone if given."""
    out = findings if changed is None else findings.join(changed.select("file").distinct(), "file", "left_semi")
    if least is not None:
        out = out.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(least)))
    return out.orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "kind").limit(most)


def limited(rows: DataFrame, order: list, most: int) -> tuple[DataFrame, int]:
    """(the first rows, how many there are in all)."""
    return rows.orderBy(*order).limit(most), rows.count()


def relevance(findings: DataFrame, impacts: DataFrame, objectives: list[str], signed: bool = False) -> DataFrame:
    """findings with relevance: the weights of the objectives they hurt, less those
    they help if signed; findings of no weight go."""
    w = F.when(F.col("direction") == "Hurts", F.col("weight")).otherwise(-F.col("weight") if signed else F.lit(0))
    per = impacts.filter(F.col("objective").isin(*objectives)).groupBy("kind").agg(F.sum(w).alias("relevance"))
    return findings.join(per, "kind").filter("relevance <> 0")


def copies_of(findings: DataFrame, most: int = 100) -> tuple[DataFrame, int]:
    """(the first findings of copied functions, how many there are)."""
    copied = findings.filter(F.col("kind").isin("ExactDuplicate", "RenamedDuplicate", "SemanticDuplicate"))
    return limited(copied, [F.desc("confidence"), "file", "line"], most)


def endpoints(routes: DataFrame, http_calls: DataFrame) -> dict[str, DataFrame]:
    """Routes (path, seq, verb, route) and client calls of a tree brought together: see
    joins.reconcile."""
    key = lambda df, name: df.select(F.struct("path", "seq").alias(name), "verb", F.col("route").alias("path"), F.col("path").alias("file"), F.col("line_start").alias("line"))
    return J.reconcile(key(http_calls, "call_seq"), key(routes, "route_seq"))


def performance_advice(findings: DataFrame, objectives: list[str], most: int = 20) -> tuple[DataFrame, int]:
    """(the findings that matter most to the objectives, worst first, how many matter)."""
    impacts = findings.sparkSession.createDataFrame(IMPACTS, "kind string, objective string, direction string, weight int")
    return limited(relevance(findings, impacts, objectives, signed=True), [F.desc("relevance"), severity_rank(F.col("severity")).desc(), "file", "line"], most)


def promoted(http_calls: DataFrame, candidates: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Client calls, with the calls of functions that turned out to wrap a client."""
    found = candidates.join(wrappers.select(F.col("name").alias("via")).distinct(), "via", "left_semi")
    return http_calls.unionByName(found.select(*http_calls.columns))


def baseline_gate(new: DataFrame, most_critical: int = 0, most_high: int = 0) -> DataFrame:
    """One row (passed, critical, high) over the findings that a baseline lacks."""
    n = new.agg(F.count_if(F.col("severity") == "Critical").alias("critical"), F.count_if(F.col("severity") == "High").alias("high"))
    return n.select(((F.col("critical") <= most_critical) & (F.col("high") <= most_high)).alias("passed"), "critical", "high")


def system_map(symbols: DataFrame, calls: DataFrame) -> dict[str, DataFrame]:
    """Modules with coupling and rank, weighted edges, and cycles between modules."""
    own = symbols.select("id", "path")
    e = calls.filter("callee_id is not null and caller_id is not null").join(own.select(F.col("id").alias("caller_id"), F.col("path").alias("src")), "caller_id").join(own.select(F.col("id").alias("callee_id"), F.col("path").alias("dst")), "callee_id").select("src", "dst")
    nodes = own.select(F.col("path").alias("node")).distinct()
    modules = nodes.join(G.coupling(e), "node", "left").join(G.pagerank(nodes, e), "node")
    weights = e.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return {"modules": modules.fillna(0), "edges": weights, "cycles": G.cycles(G.strong_components(nodes, e))}


def overview(symbols: DataFrame, calls: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    roots = symbols.select(F.col("name").alias("root")).distinct()
    return {"symbols": symbols.groupBy("lang", "kind").count(), "resolution": A.resolution_stats(calls, roots), "severities": findings.groupBy("severity").count()}


def renamed(files: DataFrame, lines: DataFrame, old: str, new: str) -> DataFrame:
    """files (path, text) with an identifier replaced, on the given (path, ln) only,
    and only where it stands as a whole word."""
    numbered = files.select("path", F.posexplode(F.split("text", "\n")).alias("ln", "line")).withColumn("ln", F.col("ln") + 1)
    marked = numbered.join(lines.select("path", "ln", F.lit(True).alias("hit")).distinct(), ["path", "ln"], "left")
    word = rf"(?<![A-Za-z0-9_$]){re.escape(old)}(?![A-Za-z0-9_])"
    by = re.sub(r"([\\$])", r"\\\1", new)  # in a replacement these two have a meaning
    done = marked.withColumn("line", F.when(F.col("hit"), F.regexp_replace("line", word, by)).otherwise(F.col("line")))
    return done.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("text"))


def deletions(symbols: DataFrame, dead: DataFrame) -> DataFrame:
    """(path, start, end) to delete for dead symbols (id), overlaps merged, so that
    a file's spans can be taken out from the bottom up."""
    spans = symbols.join(dead.select("id").distinct(), "id", "left_semi").select("path", F.col("line_start").alias("start"), F.col("line_end").alias("end"))
    return J.deoverlapped(spans, "path").select("path", "start", "end").orderBy("path", F.desc("start"))
