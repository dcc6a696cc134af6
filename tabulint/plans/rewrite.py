"""Plans that change a tree: which findings are fixed by what edit, and deletions of dead
code until nothing more is dead.  Nothing is written back here; a plan is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulint.plans import analyse as Z
from tabulint.plans.durable import saved

# What is done about a kind of finding, and from which confidence it is done unasked.
ACTIONS = {"DeadFunction": "delete", "ExactDuplicate": "merge", "RenamedDuplicate": "review", "ConventionViolation": "rename", "WeakCrypto": "replace", "HardcodedSecret": "move"}
UNASKED = 0.85


def fix_plan(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, start, end, action, unasked, kind, message): the edit for each finding that
    has one, over the symbol it is about or, without one, over its line; worst first
    within a file, from the bottom up."""
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    own = symbols.filter(F.col("kind").isin("Function", "Method", "Class")).groupBy("path", "line_start", "name").agg(F.max("line_end").alias("line_end"))
    f = findings.withColumn("action", F.try_element_at(actions, F.col("kind"))).filter("action is not null")
    on = (f["file"] == own["path"]) & (f["line"] == own["line_start"]) & (f["symbol"] == own["name"])
    out = f.join(own.select("path", "line_start", "name", "line_end"), on, "left")
    out = out.select("file", F.col("line").alias("start"), F.coalesce("line_end", "line").alias("end"), "action", (F.col("confidence") >= UNASKED).alias("unasked"), f["kind"], "message")
    return out.orderBy("file", F.desc("start"), "kind")


def without_lines(files: DataFrame, spans: DataFrame) -> DataFrame:
    """files with the lines of spans (path, start, end) taken out; other columns stay."""
    gone = spans.select(F.col("path").alias("__p"), F.explode(F.sequence("start", "end")).alias("ln")).groupBy("__p").agg(F.collect_set("ln").alias("gone"))
    both = files.join(gone, files["path"] == gone["__p"], "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).cast("int").alias("ln"))), lambda s: ~F.array_contains("gone", s["ln"])), lambda s: s["x"]), "\n")
    return both.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)).select(*files.columns)


def without_dead_code(files: DataFrame, most_rounds: int = 20, least: float = UNASKED) -> tuple[DataFrame, int]:
    """(files without the functions that are surely dead, rounds): what only dead code
    used is dead in the next round, until no round finds any, or `most_rounds`."""
    for r in range(most_rounds):
        facts = saved(Z.X.extract(files), "facts")
        symbols = Z.X.relation(facts, "symbol")
        calls = Z.resolved_calls(symbols, Z.X.relation(facts, "call").select("path", "seq", "caller_id", "callee_name", "target_kind", "line_start"))
        dead = Z.dead_code(symbols, calls).filter(F.col("confidence") >= least)
        spans = saved(dead.join(symbols, (dead["file"] == symbols["path"]) & (dead["line"] == symbols["line_start"]) & (dead["symbol"] == symbols["name"])).select("path", F.col("line_start").alias("start"), F.col("line_end").alias("end")), "dead")
        if spans.isEmpty():
            return files, r
        files = saved(without_lines(files, spans), "files")
    return files, most_rounds
