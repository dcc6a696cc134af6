"""Line-oriented operators: splitting texts, rule scans, caps, line counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Longer lines are generated code and are not scanned.
LONGEST = 10_000


def lines(files: DataFrame, path: str, text: str, *keep: str, longest: int | None = None) -> DataFrame:
    """(path, ln, line, keep...): a row per line, numbered from 1.  A final newline
    ends the last line and does not start another; an empty text has no line."""
    body = F.regexp_replace(F.col(text), r"\r?\n$", "")
    out = files.filter((F.col(text).isNotNull()) & (F.col(text) != "")).select(F.col(path), *keep, F.posexplode(F.split(body, r"\r?\n")).alias("ln", "line"))
    out = out.withColumn("ln", F.col("ln") + 1)
    return out if longest is None else out.filter(F.octet_length("line") <= longest)


@dataclass(frozen=True)
class Rule:
    """A line rule: what must match, what must not, and what a match means."""

    kind: str
    severity: str
    confidence: float
    pattern: str
    unless: str | None = None
    message: str = ""
    languages: tuple[str, ...] = ()


def scan(rows: DataFrame, rules: list[Rule], line: str = "line", lang: str | None = None) -> DataFrame:
    """rows with kind, severity, confidence and message: a row per line and rule
    that matches.  All rules are tested in one pass over a line, without a join."""
    hits = []
    for r in rules:
        ok = F.col(line).rlike(r.pattern)
        if r.unless:
            ok = ok & ~F.col(line).rlike(r.unless)
        if r.languages and lang:
            ok = ok & F.col(lang).isin(*r.languages)
        hits.append(F.when(ok, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), F.lit(r.message).alias("message"))))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return rows.withColumn("__hit", F.explode(found)).select(*rows.columns, "__hit.*")


# The secret assignment pattern and words that are no secrets.
SECRET = r"""(?i)(password|passwd|secret|api[_-]?key|token|access[_-]?key|private[_-]?key)\s*[:=]\s*['"][^'"]{8,}['"]"""
NO_SECRET = ("permission", "example", "placeholder", "default", "::class")
STATUS_WORDS = (
    "configured", "unconfigured", "enabled", "disabled", "unset", "none", "null", "empty", "missing", "present", "set", "active", "inactive", "redacted", "hidden",
    "todo", "tbd", "yes", "no", "on", "off", "true", "false", "required", "optional", "loading", "pending", "ready", "unknown",
)
KEY_PREFIXES = ("sk-", "sk_", "pk_", "rk_", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "xoxa-", "glpat-", "akia", "asia", "aiza", "ya29.", "sq0", "eyj")


def _quoted(after: Column) -> Column:
    """First quoted literal, null without one."""
    v = F.regexp_extract(after, r"""^[^'"]*(?:'([^']*)'|"([^"]*)")""", 0)
    return F.when(v != "", F.regexp_extract(v, r"""['"](.*)['"]$""", 1))


def is_hardcoded_secret(line: Column) -> Column:
    """A secret-like name assigned a literal that is no status word, template or
    plain identifier."""
    value, assigned = _quoted(F.regexp_extract(line, r"[:=](.*)$", 1)), _quoted(F.regexp_extract(line, r"=(.*)$", 1))
    status = value.contains(" ") | F.lower(value).isin(*STATUS_WORDS)
    template = value.rlike(r"[{$%<]")
    prefixed = F.lit(False)
    for p in KEY_PREFIXES:
        prefixed = prefixed | F.lower(assigned).startswith(p)
    identifier = (F.octet_length(assigned) >= 3) & ~prefixed & ~assigned.rlike("[0-9]{5}") & assigned.rlike("[._-]") & assigned.rlike(r"^[a-z0-9._-]+$")
    plain = F.lit(False)
    for w in NO_SECRET:
        plain = plain | F.lower(line).contains(w)
    yes = lambda c: F.coalesce(c, F.lit(False))
    # most lines hold neither sign and are settled without a pattern
    return (line.contains("=") | line.contains(":")) & line.rlike(SECRET) & ~plain & ~yes(status) & ~yes(template) & ~yes(identifier)


def capped(hits: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` hits of each group, each with `more`: how many hits of its
    group are left out, on the first row (0 on the others)."""
    w = W.partitionBy(*group).orderBy(*order)
    n = F.count(F.lit(1)).over(W.partitionBy(*group))
    return hits.withColumn("rank", F.row_number().over(w)).withColumn("more", F.when(F.col("rank") == 1, F.greatest(n - most, F.lit(0))).otherwise(F.lit(0))).filter(F.col("rank") <= most)


#: How a language writes comments: `c` for // and /* */, with `'` where single quotes
#: hold strings and `#` where that opens a line comment too; `hash` for # at the start of
#: a line alone.  In any other language all lines that are not blank are code.
SYNTAX = {
    **dict.fromkeys(("Rust", "Go", "Java"), "c"),
    **dict.fromkeys(("JavaScript", "TypeScript"), "c'"),
    **dict.fromkeys(("Php", "PHP", "Terraform"), "c'#"),
    **dict.fromkeys(("Python", "Yaml", "Kubernetes", "Docker", "Dockerfile"), "hash"),
}


def comment_syntax(lang: Column) -> Column:
    """The syntax of a language's comments, `none` if none is known."""
    known = F.create_map(*[F.lit(x) for pair in SYNTAX.items() for x in pair])
    return F.coalesce(F.try_element_at(known, lang), F.lit("none"))


def _tokens(quotes: str, marks: str) -> tuple[str, str]:
    """(pattern of a string or a comment, pattern of a line that leaves a block comment
    open), for scanning from outside of any comment."""
    strings = "|".join(rf"{q}(?:\\.|[^{q}\\])*+(?:{q}|\\?$)" for q in quotes)
    block = r"/\*(?:(?!\*/).)*+"
    line = "|".join([r"//.*", *(f"{m}.*" for m in marks)])
    other = rf"[^{quotes}/{marks}]|/(?![/*])"
    return rf"({strings})|{line}|{block}(?:\*/|$)", rf"^(?:{strings}|{block}\*/|{other})*+/\*"


def _outside(line: Column, syntax: Column) -> tuple[Column, Column]:
    """(whether a line holds code, whether it leaves a block comment open), if it
    starts outside of one."""
    code, opens = F.lit(True), F.lit(False)
    for name, quotes, marks in (("c", '"', ""), ("c'", "\"'", ""), ("c'#", "\"'", "#")):
        token, left_open = _tokens(quotes, marks)
        code = F.when(syntax == name, F.regexp_replace(line, token, "$1").rlike(r"\S")).otherwise(code)
        opens = F.when(syntax == name, line.rlike(left_open)).otherwise(opens)
    return code, opens


def line_kinds(rows: DataFrame, syntax: Column, path: str = "path") -> DataFrame:
    """rows (path, ln, line) with `what`: code, comment or blank.  syntax: as in SYNTAX,
    from comment_syntax().

    A line that holds anything beside comments is code; strings are code, and what
    stands in them opens no comment.  A line takes the state before it (inside a block
    comment or not) to the one after it; both cases are read off the line alone, and the
    state before a line follows from windows: the last line that ends the same way
    whatever its start, turned over by the lines since that turn the state over.
    """
    line = F.col("line")
    blank = line.rlike(r"^\s*$")
    closing = F.instr(line, "*/")
    rest = F.when(closing > 0, F.substr(line, closing + F.lit(2))).otherwise(F.lit(""))
    code, opens = _outside(line, syntax)
    code_after, opens_after = _outside(rest, syntax)
    block = syntax.startswith("c") & ~blank
    r = rows.withColumns({
        "__code0": F.when(syntax == "hash", ~line.rlike(r"^\s*#")).otherwise(code),
        "__code1": (closing > 0) & code_after,
        "__end0": F.when(block, opens.cast("int")).otherwise(0),
        "__end1": F.when(block, F.when(closing > 0, opens_after.cast("int")).otherwise(1)).otherwise(1),
    })
    turns = ((F.col("__end0") == 1) & (F.col("__end1") == 0)).cast("int")
    ordered = W.partitionBy(path).orderBy("ln")
    upto, before = ordered.rowsBetween(W.unboundedPreceding, 0), ordered.rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumn("__turns", F.sum(turns).over(upto))
    settled = F.when(F.col("__end0") == F.col("__end1"), F.struct(F.col("__end0").alias("end"), F.col("__turns").alias("turns")))
    r = r.withColumn("__last", F.last(settled, ignorenulls=True).over(before)).withColumn("__prior", F.lag("__turns", 1, 0).over(ordered))
    inside = (F.coalesce(F.col("__last.end"), F.lit(0)) + F.col("__prior") - F.coalesce(F.col("__last.turns"), F.lit(0))) % 2 == 1
    has_code = F.when(inside & syntax.startswith("c"), F.col("__code1")).otherwise(F.col("__code0"))
    out = r.withColumn("what", F.when(blank, "blank").when(has_code, "code").otherwise("comment"))
    return out.drop("__code0", "__code1", "__end0", "__end1", "__turns", "__last", "__prior")
