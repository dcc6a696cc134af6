"""Rules of single libraries, active where a manifest depends on the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulint.functions.scalar import is_comment_line

# Library, what a line holds, what anywhere in the file excuses it, severity.
RULES = (
    ("tokio", r"\.tick\(\)\.await", None, "Low", "the first tick of an interval comes at once"),
    ("tokio", r"(?<![A-Za-z0-9_])interval\(", "set_missed_tick_behavior", "Low", "missed ticks of an interval come in a burst"),
    ("udp-stream", r"(?<![A-Za-z0-9_])UDP_BUFFER_SIZE", None, "Medium", "the receive buffer is larger than a datagram"),
    ("std", r"(?<![A-Za-z0-9_])mem::forget", None, "Low", "a forgotten guard is never released"),
)


def misuse(lines: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Findings in Rust lines (path, lang, ln, line); dependencies: (name), rows of
    manifests.  The rules are a small table joined by broadcast, files that hold a
    rule's excuse are taken off by an anti join."""
    spark = lines.sparkSession
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule int, library string, pattern string, excuse string, severity string, message string")
    used = dependencies.select(F.col("name").alias("library")).unionAll(dependencies.select(F.lit("std").alias("library"))).distinct()
    active = F.broadcast(rules.join(used, "library", "left_semi"))
    code = lines.filter("lang = 'Rust'")
    hits = code.filter(~is_comment_line(F.col("line"))).join(active, F.expr("line rlike pattern"))
    excused = code.join(active.filter("excuse is not null"), F.expr("contains(line, excuse)")).select("path", "rule").distinct()
    out = hits.join(excused, ["path", "rule"], "left_anti")
    return out.select("path", "ln", F.lit("CrateApiMisuse").alias("kind"), "severity", F.lit(0.7).alias("confidence"), F.concat(F.lit("["), "library", F.lit("] "), "message").alias("message"))
