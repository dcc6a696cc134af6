"""Chains from entry points to dangerous calls, and naming conventions of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulint.functions import scalar as S
from tabulint.plans.durable import saved

# Names of dangerous calls by what they do, in languages where names tell.
SINKS = {
    "Deletion": ("delete", "destroy", "forcedelete", "truncate", "droptable", "dropdatabase", "unlink", "rmdir", "deletedirectory", "deleteprefix", "purge", "purgeexpired"),
    "Exec": ("exec", "shell_exec", "system", "passthru", "proc_open", "popen", "eval", "pcntl_exec"),
    "Sql": ("whereraw", "selectraw", "orderbyraw", "havingraw", "unprepared", "statement", "rawquery"),
    "FileSystem": ("file_get_contents", "file_put_contents", "fopen", "fwrite", "readfile", "include", "require", "require_once", "include_once"),
    "Ssrf": ("curl_exec", "curl_multi_exec"),
}
HARD_DELETION = ("forcedelete", "droptable", "dropdatabase", "unlink", "rmdir", "deletedirectory", "deleteprefix", "deletemany", "deleteone")
NAMED = ("Php", "JavaScript", "TypeScript", "Python")
GATES = ("authorize", "validate", "->can", "cannot", "gate::", "policy", "permission", "abort_unless", "abort_if", "denyaccess", "authenticate", "middleware")
UNGATED = {"Exec": "Critical", "Sql": "Critical", "Deletion": "High", "FileSystem": "Medium", "Ssrf": "High"}
RAISED = {"Low": "Medium", "Medium": "High", "High": "Critical", "Critical": "Critical"}
TIERS = ("public", "client", "application", "admin", "daemon")

# Default conventions by kind and language; others are not checked.
CONVENTIONS = {("Function", "Php"): "camel", ("Method", "Php"): "camel", ("Function", "JavaScript"): "camel", ("Method", "JavaScript"): "camel", ("Function", "TypeScript"): "camel", ("Method", "TypeScript"): "camel", ("Function", "Rust"): "snake", ("Method", "Rust"): "snake", ("Function", "Python"): "snake", ("Method", "Python"): "snake"} | {("Class", x): "pascal" for x in ("Php", "JavaScript", "TypeScript", "Rust", "Python", "Java")}


# Receivers whose methods only change memory, verbs that delete only from a
# store, and words that tell a store.
BENIGN_RECEIVERS = ("vec", "string", "vecdeque", "hashmap", "btreemap", "hashset", "btreeset", "binaryheap", "bytesmut", "bytes", "pathbuf", "osstring")
AMBIGUOUS_DELETION = ("delete", "destroy", "purge", "purgeexpired")
STORAGE_HINTS = ("file", "fs", "db", "sql", "conn", "client", "store", "repo", "bucket", "disk", "storage", "table", "model", "record", "cache", "session", "collection", "dao", "registry", "queue", "index")


def sink_of(name: Column, lang: Column) -> Column:
    """What a call does by its last name; null if nothing dangerous.  Verbs that may
    only change memory count where the receiver tells a store."""
    full = F.lower(name)
    last = F.lower(S.last_segment(name))
    receiver = F.substring(full, F.lit(1), F.length(full) - F.length(last))
    kind = F.when(full.rlike("^(" + "|".join(BENIGN_RECEIVERS) + ")::"), F.lit(None).cast("string")).when(last.isin(*HARD_DELETION), "Deletion")
    kind = kind.when(last.isin(*AMBIGUOUS_DELETION) & ~S.any_contains(receiver, STORAGE_HINTS) & ~(lang == "Php"), F.lit(None).cast("string"))
    kind = kind.when(~lang.isin(*NAMED) & last.isin(*AMBIGUOUS_DELETION), "Deletion")
    for k, names in SINKS.items():
        kind = kind.when(lang.isin(*NAMED) & last.isin(*names), k)
    return kind


def is_gate(name: Column) -> Column:
    return S.any_contains(F.lower(name), GATES)


def tier(name: Column, file: Column) -> Column:
    """How privileged code is, 0 (public) to 4, by its name and path."""
    s = F.lower(F.concat_ws(" ", name, file))
    return F.when(s.rlike("daemon|api-remote|/remote"), 4).when(s.contains("admin"), 3).when(s.contains("application"), 2).when(s.contains("client"), 1).otherwise(0)


def chains(symbols: DataFrame, calls: DataFrame, most_depth: int = 6, most_rows: int | None = 300, guarded: DataFrame | None = None) -> DataFrame:
    """(entry, sink, name, depth, gated, severity, path): from each real entry point
    the first path by breadth to each kind and name of sink, of a report's length.

    The walk goes back from the sinks, for all entry points at once: a symbol keeps the
    least of its shortest ways to each sink, with the least privileged tier of those
    without a gate and of those with one, so the work grows with calls and sinks, not
    with what each entry point reaches.  Among equal lengths the least path is the first.
    guarded: (id), entry points behind a route's authentication, which are gated from the
    start.  Without most_rows all are given.
    """
    s = symbols.select("id", "name", "full_name", "path", "lang", tier(F.col("full_name"), F.col("path")).alias("tier"))
    c = calls.filter("caller_id is not null").join(s.select(F.col("id").alias("caller_id"), "lang"), "caller_id")
    step = saved(
        c.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), sink_of(F.col("callee_name"), F.col("lang")).alias("sink"), S.last_segment(F.col("callee_name")).alias("sink_name"), is_gate(F.col("callee_name")).alias("gate")).distinct(),
        "steps",
    )
    own_gate = step.groupBy(F.col("src").alias("id")).agg(F.max("gate").alias("gate"))
    if guarded is not None:
        own_gate = own_gate.unionAll(guarded.select("id", F.lit(True).alias("gate"))).groupBy("id").agg(F.max("gate").alias("gate"))
    nodes = saved(s.join(own_gate, "id", "left").withColumn("gate", F.coalesce("gate", F.lit(False)) | is_gate(F.col("name"))), "nodes")
    entry = nodes.join(symbols.filter(F.col("is_entry_point") & ~S.is_test(F.col("path"))).select("id"), "id").groupBy(F.col("id").alias("entry")).agg(F.max("tier").alias("low"))
    edge = saved(step.filter("sink is null and dst is not null").select("src", "dst").distinct(), "edges")
    own = nodes.select(F.col("id").alias("node"), "full_name", "gate", "tier")
    key = ["node", "sink", "sink_name"]
    # ways (path, open, shut) go on from what is called: the highest tier of the way if no gate is on it, and if one is
    ahead = step.filter("sink is not null").select(F.col("src").alias("node"), "sink", "sink_name", F.array().cast("array<string>").alias("path"), F.lit(0).alias("open"), F.lit(None).cast("int").alias("shut"))
    seen, found = None, None
    for depth in range(1, most_depth + 1):
        raised = lambda x: F.when(x.isNotNull(), F.greatest(x, "tier"))
        here = ahead.join(own, "node").select(*key, F.concat(F.array("full_name"), "path").alias("path"), F.when(~F.col("gate"), raised(F.col("open"))).alias("open"), raised(F.when(F.col("gate"), F.least("open", "shut")).otherwise(F.col("shut"))).alias("shut"))
        of = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("path", c))).alias(c)
        least = here.groupBy(*key).agg(F.min("path").alias("path"), of("open"), of("shut"))
        front = least.select(*key, "path", *[F.when(F.col(f"{c}.path") == F.col("path"), F.col(f"{c}.{c}")).alias(c) for c in ("open", "shut")])
        front = saved(front if seen is None else front.join(seen, key, "left_anti"), "front")
        hit = front.withColumnRenamed("node", "entry").join(entry, "entry").select("entry", "sink", "sink_name", F.lit(depth).alias("depth"), F.col("open").isNull().alias("gated"), (F.coalesce("open", "shut") > F.col("low")).alias("raised"), "path")
        found = hit if found is None else found.unionAll(hit)
        if front.isEmpty():
            break
        seen = front.select(*key) if seen is None else seen.unionAll(front.select(*key))
        ahead = edge.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "sink", "sink_name", "path", "open", "shut")
    base = F.coalesce(*[F.when(F.col("sink") == k, F.lit(v)) for k, v in UNGATED.items()])
    severity = F.when(F.col("gated"), F.lit("Low")).otherwise(base)
    severity = F.when(F.col("raised"), F.coalesce(*[F.when(severity == a, F.lit(b)) for a, b in RAISED.items()])).otherwise(severity)
    out = found.select("entry", "sink", F.col("sink_name").alias("name"), "depth", "gated", severity.alias("severity"), "path")
    return out if most_rows is None else out.orderBy("entry", "sink", "name").limit(most_rows)


def naming(symbols: DataFrame, conventions: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """(id, name, expected, suggestion) of symbols that break the convention of
    their kind and language; names with leading underscores are left alone."""
    rules = CONVENTIONS if conventions is None else conventions
    expected = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("lang") == lang), F.lit(c)) for (k, lang), c in rules.items()])
    out = symbols.withColumn("expected", expected).filter("expected is not null and name not like '\\\\_%'").filter(~S.convention_ok(F.col("name"), F.col("expected")))
    n = F.col("name")
    suggestion = F.when(F.col("expected") == "snake", S.to_snake(n)).when(F.col("expected") == "camel", S.to_camel(n)).when(F.col("expected") == "pascal", S.to_pascal(n)).otherwise(S.to_screaming(n))
    return out.select("id", "name", "expected", suggestion.alias("suggestion"))
