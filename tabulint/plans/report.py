"""Reports: JSON, SARIF, baselines, Markdown, and source frames around findings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulint.operators.findings import severity_rank


def json_rows(findings: DataFrame) -> DataFrame:
    """(value): a JSON object per finding, to be written as text by all executors."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


SARIF = "https://json.schemastore.org/sarif-2.1.0.json"


def _sarif_result() -> Column:
    level = F.when(F.col("severity").isin("Critical", "High"), "error").when(F.col("severity") == "Medium", "warning").otherwise("note")
    region = F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.struct(F.col("kind").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("v1")).alias("partialFingerprints"))


def _sarif_tool(kinds: str, tool: str, version: str) -> Column:
    rules = F.transform(kinds, lambda k: F.struct(k.alias("id")))
    return F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), rules.alias("rules")).alias("driver"))


def sarif(findings: DataFrame, tool: str = "tabulint", version: str = "1") -> DataFrame:
    """(value): one SARIF 2.1.0 log in one row, so for the findings of one tree that a
    task holds with ease; sarif_lines() writes a log of any length."""
    rows = findings.agg(F.array_sort(F.collect_list(F.struct("file", "line", "kind", "message", _sarif_result().alias("result")))).alias("r"), F.array_sort(F.collect_set("kind")).alias("k"))
    run = F.struct(_sarif_tool("k", tool, version).alias("tool"), F.transform("r", lambda x: x["result"]).alias("results"))
    return rows.select(F.to_json(F.struct(F.lit(SARIF).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def sarif_lines(findings: DataFrame, tool: str = "tabulint", version: str = "1") -> DataFrame:
    """(value): the lines of one SARIF 2.1.0 log, in order, to be written as text: its
    beginning, a line for each result, and its end.  Results are sorted over all tasks,
    and none holds more than its part of them."""
    opening = F.concat(F.lit(f'{{"$schema":"{SARIF}","version":"2.1.0","runs":[{{"tool":'), F.to_json(_sarif_tool("k", tool, version)), F.lit(',"results":['))
    head = findings.agg(F.array_sort(F.collect_set("kind")).alias("k")).select(opening.alias("value"))
    ordered = findings.select("file", "line", "kind", "message", "severity", "fingerprint").orderBy("file", "line", "kind", "message", "severity", "fingerprint")
    # all but the first result follow a comma; the first task of a sort is never empty
    body = ordered.select(F.concat(F.when(F.monotonically_increasing_id() == 0, "").otherwise(","), F.to_json(_sarif_result())).alias("value"))
    return head.unionAll(body).unionAll(findings.sparkSession.range(1, numPartitions=1).select(F.lit("]}]}").alias("value")))


def baseline_text(findings: DataFrame) -> str:
    """A baseline file, sorted, of the distinct fingerprints."""
    rows = findings.select("fingerprint", "kind").distinct().orderBy("fingerprint", "kind").toLocalIterator()
    return json.dumps({"findings": [{"fingerprint": r.fingerprint, "kind": r.kind} for r in rows]}, indent=1)


def frames(findings: DataFrame, lines: DataFrame, around: int = 2, most: int = 50) -> DataFrame:
    """(file, line, ln, text): the source lines around the first `most` findings of
    a report, worst first."""
    first = findings.orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "kind").limit(most).select("file", "line").distinct()
    wanted = first.select("file", "line", F.explode(F.sequence(F.greatest(F.col("line") - around, F.lit(1)), F.col("line") + around)).alias("ln"))
    return wanted.join(lines.select(F.col("path").alias("file"), "ln", F.col("line").alias("text")), ["file", "ln"]).select("file", "line", "ln", "text")


def markdown(score: DataFrame, findings: DataFrame, most: int = 200) -> str:
    """A report of the score, counts by severity and the first findings."""
    s = score.first().asDict()
    out = ["# Report", "", "| dimension | score |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in s.items()], "", "| severity | findings |", "| --- | --- |"]
    out += [f"| {r.severity} | {r['count']} |" for r in findings.groupBy("severity").count().orderBy(severity_rank(F.col("severity")).desc()).collect()]
    out += ["", "| file | line | kind | message |", "| --- | --- | --- | --- |"]
    for r in findings.orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "kind").limit(most).collect():
        out.append(f"| {r.file} | {r.line} | {r.kind} | {str(r.message).replace('|', chr(92) + '|')} |")
    return "\n".join(out) + "\n"


def verdict(score: DataFrame, findings: DataFrame, gate: DataFrame, most: int = 20) -> str:
    """The outcome of a check as JSON: passed, scores, counts by severity, and the
    first findings, worst first."""
    passed, s = gate.first(), score.first().asDict()
    counts = {r["severity"]: r["count"] for r in findings.groupBy("severity").count().collect()}
    first = findings.orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "kind").limit(most).collect()
    rows = [{"file": r.file, "line": r.line, "kind": r.kind, "severity": r.severity, "message": r.message} for r in first]
    return json.dumps({"passed": bool(passed.passed), "scores": s, "findings": counts, "total": sum(counts.values()), "first": rows}, sort_keys=True)


def statistics(score: DataFrame, findings: DataFrame, at: str) -> DataFrame:
    """One row (value) for a log of checks, to be appended as text: when, the overall
    score, and findings by severity."""
    counts = findings.groupBy().agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low", "Info")])
    return score.select("overall", "security").join(counts).select(F.to_json(F.struct(F.lit(at).alias("at"), "*")).alias("value"))


def html(score: DataFrame, findings: DataFrame, most: int = 500) -> str:
    """A page of the score and the first findings, worst first, with all text escaped."""
    from html import escape

    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape(str(v))}</{tag}>" for v in values) + "</tr>"
    total = findings.count()
    rows = findings.orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "kind").limit(most).collect()
    scores = "".join(cells("td", x) for x in score.first().asDict().items())
    listed = "".join(cells("td", (r.severity, r.kind, r.file, r.line, r.message)) for r in rows)
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Report</title><style>{style}</style></head><body><h1>Report</h1><table>{scores}</table><h2>{total} findings</h2><table>{cells('th', ('severity', 'kind', 'file', 'line', 'message'))}{listed}</table></body></html>\n"


def terminal(findings: DataFrame, lines: DataFrame, around: int = 2, most: int = 20) -> str:
    """The first findings with the source lines around them, the line itself marked."""
    kept = findings.orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "kind").limit(most).collect()
    source: dict = {}
    for r in frames(findings, lines, around, most).collect():
        source.setdefault((r.file, r.line), {})[r.ln] = r.text
    out = []
    for r in kept:
        out.append(f"{r.severity} {r.kind} {r.file}:{r.line}  {r.message}")
        out += [f"{'>' if ln == r.line else ' '} {ln:>5} | {text}" for ln, text in sorted(source.get((r.file, r.line), {}).items())]
    return "\n".join(out) + "\n"
