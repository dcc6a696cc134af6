"""Tainted data followed down a file: an ordered fold per file.

The state is the set of tainted variables, so a file is folded by one task; files
are the unit of parallelism.  Between files, the functions that return tainted data
or hold a sink go round by joins until nothing new appears.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulint.operators.detectors import guarded
from tabulint.plans.durable import saved

# External input, sanitizers and sinks by language.
SOURCES = {"Php": ("$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES"), "Js": ("req.query", "req.params", "req.body"), "Rust": ("io::stdin", "stdin()", ".query_string()", "req.match_info")}
SANITIZERS = {
    "Php": ("intval(", "(int)", "(float)", "floatval(", "htmlspecialchars(", "htmlentities(", "escapeshellarg(", "escapeshellcmd(", "filter_var(", "addslashes(", "abs("),
    "Js": ("parseInt(", "parseFloat(", "Number(", "encodeURIComponent("),
    "Rust": (".parse::<", ".parse()", "canonicalize(", "sanitize", "escape(", "shell_escape"),
}
SQL = ("DB::raw(", "->raw(", "whereRaw(", "selectRaw(", "orderByRaw(", "havingRaw(", "mysql_query(", "mysqli_query(", "->unprepared(", "sqlx::query(", "sqlx::query_as(", "sql_query(")
EXEC = ("eval(", "exec(", "shell_exec(", "system(", "passthru(", "popen(", "proc_open(", "Command::new(")
HTML = ("echo ", "echo(", "print ", "print(")
PATH = ("fs::read(", "fs::read_to_string(", "fs::write(", "fs::remove_file(", "fs::remove_dir_all(", "File::open(", "File::create(", "file_get_contents(", "file_put_contents(", "unlink(", "fs.readFile", "fs.writeFile", "fs.unlink")
NO_CALLS = {"if", "for", "foreach", "while", "switch", "return", "function", "catch", "match", "array", "isset", "empty", "unset", "echo", "print", "list", "fn", "new"}
KINDS = {"Sql": "SqlInjection", "Exec": "EvalUsage", "Html": "XssVulnerability", "Path": "PathTraversal"}
LANGUAGES = {"Php": "Php", "JavaScript": "Js", "TypeScript": "Js", "Rust": "Rust"}
MOST_VARIABLES, LONGEST, ROUNDS = 512, 10_000, 3

_ASSIGN = {"Php": re.compile(r"\$(\w+)\s*([.+\-*/]?)=(?![=>])"), "Js": re.compile(r"(?:(?:let|const|var)\s+)?([A-Za-z_]\w*)\s*([.+\-*/]?)=(?![=>])"), "Rust": re.compile(r"(?:let\s+(?:mut\s+)?)?([a-z_]\w*)(?:\s*:[^=]+)?\s*([+\-*/]?)=(?![=>])")}
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
_BOUND = re.compile(r"(?:Path|Query|Json|Form)\(\s*(?:mut\s+)?([a-z_][a-z0-9_]*)\s*\)\s*:")
_READ = re.compile(r"\.(?:recv|recv_from|read|read_exact|read_to_end|read_to_string|read_line)\(\s*&mut\s+([a-z_][a-z0-9_]*)")
_NAME = re.compile(r"(?:function|fn|def)\s+([A-Za-z_]\w*)")
OUT = "path string, ln int, what string, name string, category string, confidence double, caller string, via string"


def sink(line: str, lang: str) -> str | None:
    """The category of the first sink on a line: queries, commands, pages, paths."""
    if lang == "Rust":
        sql = any(x in line for x in ("sqlx::query", "sql_query", "query_as")) and "format!" in line
    else:
        sql = any(x in line for x in SQL)
    if sql:
        return "Sql"
    if any(x in line for x in EXEC):
        return "Exec"
    if lang != "Rust" and any(x in line for x in HTML):
        return "Html"
    return "Path" if any(x in line for x in PATH) else None


def uses(text: str, name: str, lang: str) -> bool:
    before = r"\$" if lang == "Php" else r"(?<![A-Za-z0-9_.])"
    return re.search(before + re.escape(name) + r"(?![A-Za-z0-9_])", text) is not None


def starts_with_word(text: str, word: str) -> bool:
    return re.search(r"(?<![A-Za-z0-9_$])" + re.escape(word), text) is not None


def fold(lines: list[str], lang: str, returning: frozenset[str]) -> list[tuple]:
    """Rows (ln, what, name, category, confidence, caller, via): `hit` for tainted
    data at a sink, `sink` for a function that has one, `returns` for one that
    returns tainted data, `call` for a tainted argument.  Of several tainted
    variables on a line the first by name is named."""
    tainted: set[str] = set()
    out, inside = [], ""
    for ln, line in enumerate(lines, 1):
        bare = line.strip()
        if len(line.encode()) > LONGEST or bare.startswith(("//", "*", "#")):
            continue
        declares = "function " in bare or bare.startswith("def ") or (lang == "Rust" and (bare.startswith(("fn ", "pub fn ")) or "async fn " in bare))
        if declares:
            tainted = set()
            m = _NAME.search(bare)
            inside = m[1] if m else inside
        if lang == "Rust":
            for p in (_BOUND, _READ):
                tainted |= {m[1] for m in p.finditer(line) if len(tainted) < MOST_VARIABLES}
        clean, direct = any(s in line for s in SANITIZERS[lang]), any(s in line for s in SOURCES[lang])
        used = next((v for v in sorted(tainted) if uses(line, v, lang)), None)
        category = sink(line, lang)
        if category and inside:
            out.append((ln, "sink", inside, category, None, inside, None))
        if (direct or used) and not clean:
            confidence, via = (0.9, "input used directly") if direct else (0.8, f"via `{used}`")
            if category:
                out.append((ln, "hit", category, category, confidence - (0.05 if category == "Html" else 0), inside, via))
            elif re.search("SELECT |INSERT |UPDATE |DELETE FROM|WHERE ", line.upper()) and any(x in line for x in (". $", ".$", "+ ", "${")):
                out.append((ln, "hit", "Sql", "Sql", confidence - 0.05, inside, via))
            if bare.startswith(("return ", "return$")) and inside:
                out.append((ln, "returns", inside, None, None, inside, via))
            if not category:
                for m in _CALL.finditer(line):
                    args = line[m.end() :]
                    if m[1] in NO_CALLS or re.search(r"\b(fn|function|def)$", line[: m.start()].rstrip()):
                        continue
                    if any(s in args for s in SOURCES[lang]) or (used and uses(args, used, lang)):
                        out.append((ln, "call", m[1], None, confidence, inside, via))
        m = _ASSIGN[lang].search(line)
        if m:
            after = line.split("=", 1)[1]
            returned = any(starts_with_word(after, f + "(") for f in returning)
            if (direct or returned) and not clean and len(tainted) < MOST_VARIABLES:
                tainted.add(m[1])
            elif not m[2] and (clean or (not direct and used is None)):
                tainted.discard(m[1])
            elif used and not clean and len(tainted) < MOST_VARIABLES:
                tainted.add(m[1])
    return out


def safe_fold(lines: list[str], lang: str, returning: frozenset[str]) -> list[tuple]:
    """fold(), without rows for a file that it cannot read: one file stops no other."""
    try:
        return fold(lines, lang, returning)
    except Exception:  # noqa: BLE001
        return []


def scan(files: DataFrame, returning: frozenset[str] = frozenset()) -> DataFrame:
    """The fold's rows for files (path, lang, text)."""
    import pandas as pd

    columns = ["path", "ln", "what", "name", "category", "confidence", "caller", "via"]

    def run(parts):
        for p in parts:
            rows = [(path, *r) for path, lang, text in zip(p["path"], p["lang"], p["text"]) for r in safe_fold((text or "").splitlines(), LANGUAGES[lang], returning)]
            yield pd.DataFrame(rows, columns=columns).astype({"ln": "int32"})

    return files.filter(F.col("lang").isin(*LANGUAGES) & guarded(F.col("path"))).select("path", "lang", "text").mapInPandas(run, OUT)


def findings(files: DataFrame, most_returning: int = 100_000) -> DataFrame:
    """(path, ln, kind, severity, confidence, via): tainted data at sinks, in the
    same function and across one call.  Names of functions that return tainted data
    feed the next round, three at most; a name defined twice is never followed."""
    names: set[str] = set()
    rows = None
    for _ in range(ROUNDS):
        rows = saved(scan(files, frozenset(names)), "taint")
        new = {r.name for r in rows.filter("what = 'returns'").select("name").distinct().limit(most_returning + 1).collect()}
        if len(new) > most_returning:
            raise ValueError("too many functions return tainted data to be named in a scan")
        if new <= names:
            break
        names |= new
    kind = F.coalesce(*[F.when(F.col("category") == c, F.lit(k)) for c, k in KINDS.items()])
    severity = F.when(F.col("category").isin("Html", "Path"), "High").otherwise("Critical")
    direct = rows.filter("what = 'hit'").select("path", "ln", kind.alias("kind"), severity.alias("severity"), "confidence", "via")
    sinks = rows.filter("what = 'sink'").groupBy("name").agg(F.min(F.struct("ln", "category")).alias("s"), F.countDistinct("path").alias("files")).filter("files = 1")
    across = rows.filter("what = 'call'").select("path", "ln", "name", "via").distinct().join(sinks, "name").withColumn("category", F.col("s.category"))
    across = across.groupBy("path", "ln", "name", "category").agg(F.min("via").alias("via")).select("path", "ln", kind.alias("kind"), F.lit("High").alias("severity"), F.lit(0.6).alias("confidence"), F.concat(F.lit("into "), "name", F.lit(": "), "via").alias("via"))
    return direct.unionAll(across)
