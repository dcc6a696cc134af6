"""The whole analysis of a tree, from files to findings, score and gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulint.functions.scalar import is_auxiliary, is_test, last_segment, version
from tabulint.operators import aggregates as A
from tabulint.operators import chains, detectors, folds, infra, joins, libraries, taint
from tabulint.operators import findings as P
from tabulint.operators import graph as G
from tabulint.operators.lines import LONGEST, lines
from tabulint.plans.durable import saved
from tabulint.sources import config
from tabulint.sources import extract as X
from tabulint.sources import files as S

COLUMNS = ("file", "line", "kind", "severity", "confidence", "message", "symbol", "pass_rank")


def resolved_calls(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """calls with callee_id: by the tiers of joins.method_tiers, each time if one symbol
    fits or one in the file."""
    named, tiers = joins.method_tiers(symbols.select("id", "name", "full_name", "kind", "parent_id", F.col("path").alias("group"), "line_start"))
    owners = joins.with_class(symbols).select(F.col("id").alias("caller_id"), F.col("class_id").alias("owner"))
    asked = calls.filter("target_kind = 'Unresolved'").join(owners, "caller_id", "left").select(F.col("seq").alias("s"), F.col("path").alias("group"), F.col("callee_name").alias("name"), "owner").withColumn("call_id", F.struct("group", "s"))
    done = joins.resolve(asked, named, tiers, ["group", "line_start"]).filter("target is not null").select(F.col("group").alias("path"), F.col("s").alias("seq"), F.col("target").alias("callee_id"))
    out = calls.join(done, ["path", "seq"], "left")
    return out.withColumn("target_kind", F.when(F.col("callee_id").isNotNull(), "Resolved").otherwise(F.col("target_kind")))


def dead_code(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions that no resolved call, no name and no entry point reaches.  Next to
    dynamic calls in its file a finding is less certain."""
    edges = calls.filter("callee_id is not null and caller_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))
    live = G.reachable(symbols.filter("is_entry_point").select(F.col("id").alias("node")), edges).select(F.col("node").alias("id"))
    called = calls.filter("callee_id is not null").select(F.col("callee_id").alias("id")).distinct()
    words = calls.filter("target_kind = 'Unresolved'").select(F.explode(F.array("callee_name", F.substring_index("callee_name", "::", -1), F.substring_index("callee_name", ".", -1), last_segment(F.col("callee_name")))).alias("name")).distinct()
    dynamic = calls.filter("target_kind = 'Dynamic'").select("path", F.lit(True).alias("dynamic")).distinct()
    special = F.col("name").isin("constructor", "main", "new", "init") | F.col("name").rlike("^__.+__$")
    left = symbols.filter(F.col("kind").isin("Function", "Method") & ~F.coalesce("is_entry_point", F.lit(False)) & ~special & ~is_test(F.col("path")))
    for known, on in ((live, "id"), (called, "id"), (words, "name")):
        left = left.join(known, on, "left_anti")
    out = left.join(dynamic, "path", "left")
    return out.select(F.col("path").alias("file"), F.col("line_start").alias("line"), F.lit("DeadFunction").alias("kind"), F.lit("Low").alias("severity"), F.when(F.col("dynamic"), 0.6).otherwise(0.95).alias("confidence"), F.concat(F.lit("never used: "), "name").alias("message"), F.col("name").alias("symbol"))


def test_reachability(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, functions, reached, percent): shipped functions that tests reach."""
    edges = calls.filter("callee_id is not null and caller_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))
    own = symbols.filter(F.col("kind").isin("Function", "Method"))
    roots = own.filter(is_test(F.col("path"))).select(F.col("id").alias("node"))
    hit = G.reachable(roots, edges).select(F.col("node").alias("id"), F.lit(1).alias("hit"))
    out = own.filter(~is_auxiliary(F.col("path"))).join(hit, "id", "left").groupBy(F.col("path").alias("file")).agg(F.count("*").alias("functions"), F.count("hit").alias("reached"))
    return out.withColumn("percent", F.round(100.0 * F.col("reached") / F.col("functions"), 1))


def duplicates(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Copies of functions: exact ones, then renamed ones of two lines or more, then
    those of equal flow; the one with most call sites is the original.  symbols may have
    flow_hash; without it the normalised hash stands for it, and no more is found."""
    own = symbols.filter(F.col("kind").isin("Function", "Method"))
    flow = F.col("flow_hash" if "flow_hash" in symbols.columns else "normalized_hash").alias("flow")
    levels = [F.col("hash"), *[F.when(F.col("line_end") > F.col("line_start"), F.col(c)) for c in ("normalized_hash", "flow")]]
    weighed = own.select("id", "hash", "normalized_hash", flow, "line_start", "line_end").join(A.call_sites(own, calls).select("id", "sites"), "id", "left")
    groups = A.duplicate_cascade(weighed, "id", levels, F.col("sites")).filter("id <> canonical")
    by_level = lambda *values: F.element_at(F.array(*map(F.lit, values)), F.col("level"))
    kind = by_level("ExactDuplicate", "RenamedDuplicate", "SemanticDuplicate")
    return groups.join(own, "id").select(F.col("path").alias("file"), F.col("line_start").alias("line"), kind.alias("kind"), F.lit("Low").alias("severity"), by_level(0.99, 0.9, 0.7).alias("confidence"), F.concat(F.lit("copy of another function: "), "name").alias("message"), F.col("name").alias("symbol"))


#: A comment that tells the checks to pass over its line and the next, with or without kinds.
IGNORE = r"(?://|#|/\*|<!--)\s*lint:ignore\b\s*([A-Za-z, ]*)"


def suppressions(rows: DataFrame) -> DataFrame:
    """(file, ln, kinds): the comments of lines (path, ln, line) that suppress findings;
    null kinds stand for all."""
    kinds = F.filter(F.split(F.regexp_extract("line", IGNORE, 1), r"[,\s]+"), lambda k: k != "")
    return rows.filter(F.col("line").rlike(IGNORE)).select(F.col("path").alias("file"), "ln", F.when(F.size(kinds) > 0, kinds).alias("kinds"))


def dependency_findings(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Locked packages on several compatibility lines, and those that an advisory
    (package, patched) applies to."""
    lock = rows.filter(F.col("path").rlike(r"(^|/)Cargo\.lock$"))
    locked = S.cargo_lock(lock)
    where = lambda df, kind, severity, confidence, message: df.select(F.col("path").alias("file"), F.lit(0).alias("line"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), message.alias("message"), F.lit(None).cast("string").alias("symbol"))
    files = locked.groupBy("name").agg(F.min("path").alias("path"))
    out = where(A.duplicate_dependencies(locked).join(files, "name"), "DuplicateDependency", "Low", 0.9, F.concat_ws(" ", "name", F.array_join("lines", ", ")))
    if known is not None:
        hit = joins.advisories(locked.withColumn("version", version(F.col("version"))), known)
        out = out.unionByName(where(hit, "VulnerableDependency", "High", 0.95, F.concat(F.lit("an advisory applies to "), "name")))
    return out


def route_findings(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routes of route files with their middleware, findings of those without
    authentication)."""
    import pandas as pd

    def run(parts):
        for p in parts:
            rows = [(path, ln, verb, route, guards) for path, text in zip(p["path"], p["text"]) for verb, route, guards, ln in X.safe_routes(path, text or "")]
            yield pd.DataFrame(rows, columns=["file", "line", "verb", "route", "middleware"]).astype({"line": "int32"})

    php = files.filter("lang = 'Php'").filter(F.col("text").contains("Route::") & F.col("path").rlike("(^|/)routes/"))
    routes = saved(php.select("path", "text").mapInPandas(run, "file string, line int, verb string, route string, middleware array<string>"), "routes")
    none = files.sparkSession.createDataFrame([], "file string, start int, end int")
    return routes, folds.unauthenticated_routes(routes, none)


def analyse(files: DataFrame, settings: dict | None = None, advisories: DataFrame | None = None, baseline: DataFrame | None = None) -> dict[str, DataFrame]:
    """symbols, calls, routes, http_calls, findings, score, reachability and more of
    files (path, lang, text).  Facts are extracted once and written.

    settings: as config.load() gives them.  advisories: (package, patched).  baseline:
    (fingerprint); with it `new`, `existing` and `resolved` are given too."""
    settings = settings or config.load(None)
    everything = saved(X.extract(files), "facts")
    symbols = X.relation(everything, "symbol")
    calls = saved(resolved_calls(symbols, X.relation(everything, "call").select("path", "seq", "caller_id", "callee_name", "target_kind", "line_start")), "calls")
    rows = saved(lines(files, "path", "text", "lang", longest=LONGEST), "lines")
    none = F.lit(None).cast("string")
    shape = lambda df: df.select(F.col("path").alias("file"), F.col("ln").alias("line"), "kind", "severity", F.coalesce("confidence", F.lit(0.8)).alias("confidence"), "message", none.alias("symbol"))
    docs = S.yaml_documents(rows.filter("lang = 'Yaml'"))
    docs = docs.filter(docs["text"].rlike("(?m)^apiVersion:") & docs["text"].rlike("(?m)^kind:"))
    failures = X.relation(everything, "failure").select(F.col("path").alias("file"), F.lit(1).alias("line"), F.lit("ParseFailure").alias("kind"), F.lit("Info").alias("severity"), F.lit(1.0).alias("confidence"), F.lit("the file could not be parsed").alias("message"), none.alias("symbol"))
    code = settings["code"]
    heavy = A.complexity(symbols.withColumnRenamed("id", "symbol_id"), code["max_function_lines"], code["max_params"], code["max_methods"]).join(symbols.withColumnRenamed("id", "symbol_id"), "symbol_id")
    of = lambda df, kind, severity, confidence, message: df.select(F.col("path").alias("file"), F.col("line_start").alias("line"), kind.alias("kind"), severity.alias("severity"), F.lit(confidence).alias("confidence"), message.alias("message"), F.col("name").alias("symbol"))
    heavy = of(heavy, F.col("finding"), F.lit("Low"), 0.9, F.concat_ws(" ", F.col("finding"), F.col("value").cast("string")))
    wrong = chains.naming(symbols).drop("name").join(symbols, "id")
    wrong = of(wrong, F.lit("ConventionViolation"), F.lit("Info"), 0.8, F.concat(F.lit("expected "), "suggestion"))
    routes, open_routes = route_findings(files)
    manifests = S.toml_dependencies(rows.filter(F.col("path").rlike(r"(^|/)Cargo\.toml$"))).select("name").distinct()
    source = rows.filter(F.col("lang").isNotNull())
    passes = [
        dead_code(symbols, calls), duplicates(symbols, calls), heavy, shape(detectors.security(source)), shape(detectors.forbidden_calls(source, settings["security"]["forbid_weak_crypto"])),
        shape(taint.findings(files).withColumnRenamed("via", "message")), shape(detectors.rust(source, symbols=symbols)), shape(detectors.datagrams(source)),
        shape(folds.folded(files)), shape(folds.split_messages(source)), shape(folds.unchecked_lengths(source.filter(F.col("lang").isin("Rust", "Go", "JavaScript", "TypeScript", "Java")))),
        *[shape(f(source.filter(F.col("lang") == lang)).withColumn("confidence", F.lit(None).cast("double"))) for f, lang in ((infra.dockerfile, "Dockerfile"), (infra.terraform, "Terraform"))],
        shape(infra.kubernetes(docs).withColumn("confidence", F.lit(None).cast("double"))), failures, wrong, _chain_findings(symbols, calls), shape(libraries.misuse(source, manifests)), shape(open_routes), dependency_findings(rows, advisories),
    ]
    out = None
    for rank, p in enumerate(passes):
        p = p.withColumn("line", F.col("line").cast("int")).withColumn("confidence", F.col("confidence").cast("double")).withColumn("pass_rank", F.lit(rank)).select(*COLUMNS)
        out = p if out is None else out.unionByName(p)
    out = saved(P.first_wins(P.shipped(out), ["kind", "file", "line"], ["pass_rank", "message"]), "found")
    sites = saved(suppressions(rows), "sites")
    if not sites.isEmpty():
        kept, _, stale = joins.suppress(out, sites)
        stale = stale.select("file", F.col("ln").alias("line"), F.lit("StaleSuppression").alias("kind"), F.lit("Info").alias("severity"), F.lit(1.0).alias("confidence"), F.lit("suppresses nothing").alias("message"), none.alias("symbol"), F.lit(len(passes)).alias("pass_rank"))
        out = kept.unionByName(stale)
    found = saved(P.fingerprints(out, ["file", "line", "kind", "message"]), "findings")
    reach = saved(test_reachability(symbols, calls), "reach")
    tested = P.test_dimension(reach, not symbols.filter(is_test(F.col("path"))).isEmpty())
    result = {
        "symbols": symbols, "calls": calls, "routes": X.relation(everything, "route"), "guarded_routes": routes, "http_calls": X.relation(everything, "http_call"), "lines": rows, "findings": found,
        "score": P.score(found, symbols.count(), tested), "reachability": reach,
    }
    if baseline is not None:
        result |= joins.baseline_diff(found, baseline, F.col("severity") != "Info")
    return result


def _chain_findings(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Dangerous chains as findings at their entry points."""
    c = chains.chains(symbols, calls).select(F.col("entry").alias("id"), "sink", F.col("name").alias("sink_name"), "severity", F.array_join("path", " > ").alias("way"))
    c = c.join(symbols.select("id", "path", "line_start", "name"), "id")
    return c.select(F.col("path").alias("file"), F.col("line_start").alias("line"), F.lit("DangerousChain").alias("kind"), "severity", F.lit(0.7).alias("confidence"), F.concat_ws(" ", F.lit("reaches"), "sink", "sink_name", F.lit("by"), "way").alias("message"), F.col("name").alias("symbol"))
