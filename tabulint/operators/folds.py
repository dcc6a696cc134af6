"""Detectors with state down a file: guards over suspension points, wire lengths,
nonces, eager loading, hook dependencies, split messages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulint.functions.scalar import without_line_comment
from tabulint.operators.detectors import DATAGRAM

OUT = "path string, ln int, kind string, severity string, confidence double, message string"
_GUARD = re.compile(r"^\s*let\s+(?:mut\s+)?(\w+)\s*=\s*.*?\.(?:lock|borrow_mut|borrow)\(\)\s*(\.unwrap\(\)|\.expect\([^;]*\))?\s*\??\s*;?\s*$")
_ASYNC = re.compile(r"\basync\s+(fn|move)\b")
_HOOK = re.compile(r"(?<![A-Za-z0-9_$])(useEffect|useCallback|useMemo)\s*\(")
_NONCE = re.compile(r"(?:let\s+(?:mut\s+)?|const\s+)(\w+)[^=]*=\s*&?\[\s*\w+\s*;\s*(?:12|16|24)\s*\]")
_LITERAL = re.compile(r"\[\s*\w+\s*;\s*(?:12|16|24)\s*\]")
# Where nonces are used, and what fills them.
NONCE_SINKS = (".encrypt(", ".seal(", "Nonce::from_slice(")
RANDOM = ("fill_bytes(", "generate_nonce(", "OsRng", "ThreadRng", "thread_rng(", "rand::", "getrandom(", "SystemRandom", ".fill(")


def lock_over_await(lines: list[str]) -> list[tuple]:
    """Guards that still live at an await; the first await uses a guard up."""
    out, depth, live, fn_depth = [], 0, [], None
    for ln, raw in enumerate(lines, 1):
        code = raw.split("//", 1)[0]
        if fn_depth is None and _ASYNC.search(code):
            fn_depth, live = depth, []
        if fn_depth is not None:
            if ".await" in code and live:
                out += [(ln, "LockAcrossAwait", "Medium", 0.7, f"guard `{name}` of line {at} lives over an await") for name, _, at in live]
                live = []
            live = [g for g in live if f"drop({g[0]}" not in code]
            m = _GUARD.match(code)
            if m and m[1] != "_":
                live.append((m[1], depth, ln))
        depth += code.count("{") - code.count("}")
        live = [g for g in live if g[1] <= depth]
        if fn_depth is not None and depth <= fn_depth and "}" in code:
            fn_depth, live = None, []
    return out


def eager_loading(lines: list[str], path: str) -> list[tuple]:
    """Transformers whose methods follow relations that nothing loads at once."""
    text = "\n".join(lines)
    if not re.search("Transformer|Resource|Presenter", path) or not re.search("TransformerAbstract|JsonResource|Fractal", text) or re.search(r"->with\(\s*\[", text):
        return []
    out, start, depth, entered, hits = [], 0, 0, False, 0
    for ln, line in enumerate(lines, 1):
        if not start and re.search(r"function\s+(transform|toArray)\s*\(", line):
            start, depth, entered, hits = ln, 0, False, 0
        if start:
            entered |= "{" in line
            depth += line.count("{") - line.count("}")
            if entered and depth > 0:
                hits += len(re.findall(r"\$\w+->\w+->\w+", line))
            if entered and depth <= 0:
                if hits:
                    out.append((start, "NPlusOneQuery", "Medium", 0.65, f"{hits} relations followed without eager loading"))
                start = 0
    return out


def hook_dependencies(lines: list[str]) -> list[tuple]:
    """Hook calls whose arguments hold no list after a top-level comma."""
    text, out = "\n".join(lines), []
    for m in _HOOK.finditer(text):
        ln = text.count("\n", 0, m.start()) + 1
        if lines[ln - 1].lstrip().startswith(("//", "*")):
            continue
        i, depth, listed, comma, closed = m.end(), 1, False, False, False
        while i < len(text) and depth:
            c = text[i]
            if c in "'\"`":
                j = i + 1
                while j < len(text) and text[j] != c:
                    j += 2 if text[j] == "\\" else 1
                i = j
            elif c in "([{":
                listed |= c == "[" and depth == 1 and comma
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == "," and depth == 1:
                comma = True
            closed = depth == 0
            i += 1
        if closed and not listed:
            out.append((ln, "MissingHookDependencies", "Low", 0.8, f"{m[1]} without dependencies"))
    return out


def static_nonces(lines: list[str]) -> list[tuple]:
    """Constant nonces at encryption calls, directly or by a variable that nothing
    random fills between its declaration and the call."""
    out, known = [], {}
    for ln, raw in enumerate(lines, 1):
        code = raw.split("//", 1)[0]
        if any(s in code for s in NONCE_SINKS):
            if _LITERAL.search(code):
                out.append((ln, "StaticAeadNonce", "High", 0.8, "constant nonce"))
            else:
                for name, at in known.items():
                    between = lines[at - 1 : ln]
                    if re.search(rf"\b{re.escape(name)}\b", code) and not any(re.search(rf"\b{re.escape(name)}\b", x) and any(r in x for r in RANDOM) for x in between):
                        out.append((ln, "StaticAeadNonce", "High", 0.75, f"nonce `{name}` of line {at} is constant"))
                        break
        elif m := _NONCE.search(code):
            known[m[1]] = ln
    return out


def folded(files: DataFrame) -> DataFrame:
    """All folds over files (path, lang, text), a file at a time."""
    import pandas as pd

    def run(parts):
        for p in parts:
            rows = []
            for path, lang, text in zip(p["path"], p["lang"], p["text"]):
                lines = (text or "").splitlines()
                found = []
                if lang == "Rust":
                    found = lock_over_await(lines) + static_nonces(lines)
                elif lang == "Php":
                    found = eager_loading(lines, path)
                elif lang in ("JavaScript", "TypeScript"):
                    found = hook_dependencies(lines)
                rows += [(path, *x) for x in found]
            yield pd.DataFrame(rows, columns=["path", "ln", "kind", "severity", "confidence", "message"]).astype({"ln": "int32"})

    return files.filter(F.col("lang").isin("Rust", "Php", "JavaScript", "TypeScript")).select("path", "lang", "text").mapInPandas(run, OUT)


def split_messages(lines: DataFrame) -> DataFrame:
    """Functions of datagram files that write one message, with its header, in
    several writes: counted per function by windows."""
    w = W.partitionBy("path").orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    used = lines.filter(F.col("line").rlike(DATAGRAM)).select("path").distinct()
    code = without_line_comment(F.col("line"))
    declares = code.rlike(r"\b(fn|func|function|def)\s+\w+|^\s*(async\s+)?\w+\s*\([^)]*\)\s*\{")
    rows = lines.join(used, "path", "left_semi").withColumn("fn", F.sum(declares.cast("int")).over(w))
    writes = rows.filter(code.rlike(r"\.(write_all|write|write_buf|send|send_to|sendto)\(|\.poll_send"))
    header = F.col("line").rlike("to_be_bytes|to_le_bytes|header")
    per = writes.groupBy("path", "fn").agg(F.count("*").alias("n"), F.min(F.when(header, F.col("ln"))).alias("ln")).filter("n >= 2 and ln is not null")
    return per.select("path", "ln", F.lit("SplitDatagramMessage").alias("kind"), F.lit("High").alias("severity"), F.lit(0.75).alias("confidence"), F.concat(F.lit("one message in "), F.col("n").cast("string"), F.lit(" writes")).alias("message"))


def unchecked_lengths(lines: DataFrame) -> DataFrame:
    """Lengths parsed from the wire that size a buffer and that no line of the file
    checks against a bound."""
    code = without_line_comment(F.col("line"))
    rows = lines.withColumn("code", code)
    parsed = rows.filter(F.col("code").rlike("from_be_bytes|from_le_bytes|read_u32|read_u64|getInt|readUInt32|Uint32|Uint64") & ~F.col("code").rlike("u8|u16|U16|Uint16|UInt16"))
    names = parsed.select("path", F.regexp_extract("code", r"(?:let\s+(?:mut\s+)?|const\s+|var\s+)?([A-Za-z_]\w+)\s*(?::[^=]+)?:?=[^=]", 1).alias("name"), F.col("ln").alias("at")).filter("name <> ''")
    words = rows.select("path", "ln", "code", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)))).alias("name"))
    uses = words.join(names.groupBy("path", "name").agg(F.min("at").alias("at")), ["path", "name"])
    sink = F.col("code").rlike(r"with_capacity\(|vec!\[|resize\(|reserve\(|read_exact\(|make\(\[\]|new byte\[|Buffer\.alloc|\.take\(")
    checked = F.col("code").rlike(r"(?i)[<>]=?\s*\w|\.min\(|max_|limit|checked_|clamp\(|assert|ensure!|try_from")
    per = uses.groupBy("path", "name").agg(F.min(F.when(sink, F.col("ln"))).alias("ln"), F.max(checked & (F.col("ln") != F.col("at")) & ~sink).alias("bounded"))
    hit = per.filter(F.col("ln").isNotNull() & ~F.coalesce("bounded", F.lit(False)))
    return hit.select("path", "ln", F.lit("UnvalidatedLengthPrefix").alias("kind"), F.lit("Medium").alias("severity"), F.lit(0.65).alias("confidence"), F.concat(F.lit("length from the wire without a bound: "), "name").alias("message"))


def unauthenticated_routes(routes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Routes (file, line, verb, route, middleware) of PHP files without
    authentication, their own or of a group range (file, start, end) around them."""
    auth = r"(?i)^(auth|auth:.*|can|can:.*|verified|sanctum|jwt(\.auth)?|role(:.*)?|permission(:.*)?)$"
    own = F.exists("middleware", lambda m: m.rlike(auth))
    name = F.substring_index("file", "/", -1)
    open_ = routes.filter(F.col("file").endswith(".php") & (F.col("route") != "") & ~own & ~name.isin("auth.php", "admin.php") & ~F.lower("route").rlike("health|status|ping"))
    r = ranges.select(F.col("file").alias("__f"), "start", "end")
    out = open_.join(r, (F.col("file") == F.col("__f")) & F.col("line").between(F.col("start"), F.col("end")), "left_anti")
    return out.select(F.col("file").alias("path"), F.col("line").alias("ln"), F.lit("MissingAuthMiddleware").alias("kind"), F.lit("High").alias("severity"), F.lit(0.9).alias("confidence"), F.concat_ws(" ", F.upper("verb"), "route", F.lit("has no authentication")).alias("message"))
