"""Source-code detectors over lines (path, lang, ln, line): rule lists, and windows where lines matter together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulint.functions.scalar import is_comment_line, is_test, without_line_comment
from tabulint.operators.joins import enclosing
from tabulint.operators.lines import Rule, capped, is_hardcoded_secret, scan

DYNAMIC = ("Php", "JavaScript", "TypeScript", "Python")
# Words around a weak hash that decide how much it matters.
SENSITIVE = r"(?i)password|passwd|token|secret|sign|verify|hmac|certificate"
BENIGN = r"""(?i)cache|etag|checksum|fingerprint|\$hash|\$key|\$id|gravatar|->md5|'md5'|"md5"|md5 =>|->id|'id' =>|"id" =>|md5\(strtolower"""
UNBOUNDED = r"mpsc::channel\(\)|unbounded_channel\(|unbounded::<|channel::unbounded\("
BLOCKING = r"std::thread::sleep|thread::sleep\(|std::fs::|std::net::|\.recv\(\)|block_on\(|reqwest::blocking|std::io::stdin"
PANICS = r"\.unwrap\(|\.expect\(|panic!\(|todo!\(|unimplemented!\(|unreachable!\("
SAFE_UNWRAP = r"writeln?!\(|Regex::new\(\s*r?#*\"|\.(lock|read|write|borrow|borrow_mut)\(\)\.(unwrap|expect)"
HOT = r"(?i)(handle|process|recv|send|poll|decode|encode|on_)(_|$|packet|frame|message|datagram)"
ALLOCATIONS = r"\.to_vec\(|\.to_string\(|\.to_owned\(|\.clone\(|Vec::new\(|Vec::with_capacity\(|String::new\(|format!\(|Box::new\(|\.collect\(|vec!\["
DATAGRAM = r"UdpSocket|UdpStream|UdpFramed|SOCK_DGRAM|node:dgram|dgram\.createSocket|DatagramSocket|ListenUDP|DialUDP|UDPConn"
LARGEST_DATAGRAM = 1472
SENSITIVE_NAME = r"\b(?:\w+[._])*(?:hmac|cmac|signature|secret|digest|verifier|auth_tag|mac_tag|gcm_tag|expected_mac|computed_mac|(?:access|auth|api|csrf|bearer|refresh|session|secret)_token|(?:password|pwd|pass|credential|secret|key)_hash)\b"
SAFE_COMPARISON = r"ct_eq\(|ConstantTimeEq|constant_time_eq|subtle::|ring::constant_time"

CODE = [
    Rule("EvalUsage", "Critical", 0.99, r"(?<![A-Za-z0-9_$])eval\(", message="eval", languages=DYNAMIC),
    Rule("UnboundedChannel", "Medium", 0.7, UNBOUNDED, message="unbounded channel", languages=("Rust",)),
]
COLUMNS = ["path", "ln", "kind", "severity", "confidence", "message"]


#: Paths whose files no security detector looks at: libraries, build output, sample data.
UNGUARDED = r"(^|.*/)(vendor|node_modules)/|storage/framework/|/(benchmarks|testdata|test-data|corpus)/|\.blade\.php$"


def guarded(path: Column) -> Column:
    """Whether security detectors look at a file: no library, no build output, no
    sample data, no test; fixtures of tests are looked at."""
    tests = path.rlike(r"/tests/|_test\.rs$") & ~path.contains("fixtures")
    return ~path.rlike(UNGUARDED) & ~tests


def forbidden_calls(lines: DataFrame, names: list[str]) -> DataFrame:
    """Calls of functions that the settings forbid, where a line's first mention of the
    name stands at the start of a word; in languages where names tell."""
    code = lines.filter(F.col("lang").isin(*DYNAMIC) & ~is_comment_line(F.col("line")) & guarded(F.col("path")))
    out = None
    for n in dict.fromkeys(names):
        at = F.instr("line", f"{n}(")
        hit = code.filter((at > 0) & ((at == 1) | ~F.substr("line", at - 1, F.lit(1)).rlike("[A-Za-z0-9_]")))
        hit = hit.select("path", "ln", F.lit("WeakCrypto").alias("kind"), F.lit("Critical").alias("severity"), F.lit(0.95).alias("confidence"), F.lit(f"forbidden function {n}()").alias("message"))
        out = hit if out is None else out.unionByName(hit)
    return lines.sparkSession.createDataFrame([], "path string, ln int, kind string, severity string, confidence double, message string") if out is None else out


def security(lines: DataFrame) -> DataFrame:
    """Weak hashes, eval and secrets; comment lines and unguarded files give nothing."""
    code = lines.filter(~is_comment_line(F.col("line")) & guarded(F.col("path")))
    out = scan(code, CODE, lang="lang").select(*COLUMNS)
    weak = code.filter(F.col("lang").isin(*DYNAMIC) & F.col("line").rlike(r"(?<![A-Za-z0-9_$])(md5|sha1)\("))
    severity = F.when(F.col("line").rlike(SENSITIVE), "Critical").when(F.col("line").rlike(BENIGN), "Info").otherwise("Medium")
    weak = weak.withColumn("severity", severity).filter("severity <> 'Info'")
    weak = weak.select("path", "ln", F.lit("WeakCrypto").alias("kind"), "severity", F.when(F.col("severity") == "Critical", 0.95).otherwise(0.6).alias("confidence"), F.lit("weak hash").alias("message"))
    secret = code.filter(is_hardcoded_secret(F.col("line"))).select("path", "ln", F.lit("HardcodedSecret").alias("kind"), F.lit("Critical").alias("severity"), F.lit(0.8).alias("confidence"), F.lit("secret in code").alias("message"))
    return out.unionByName(weak).unionByName(secret)


def rust(lines: DataFrame, most_panics: int = 5, symbols: DataFrame | None = None) -> DataFrame:
    """Rust findings.  The function a line stands in is the innermost one of symbols
    (id, path, name, kind, line_start, line_end) around it, or without symbols the last
    declaration above it; whether it is asynchronous or latency-sensitive follows from
    its declaration."""
    w = W.partitionBy("path").orderBy("ln")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = lines.filter("lang = 'Rust'").withColumn("code", without_line_comment(F.col("line")))
    declares = F.col("code").rlike(r"\bfn\s+\w+")
    rows = rows.withColumn("fn", F.last(F.when(declares, F.regexp_extract("code", r"\bfn\s+(\w+)", 1)), ignorenulls=True).over(upto))
    rows = rows.withColumn("is_async", F.coalesce(F.last(F.when(declares, F.col("code").rlike(r"async\s+(fn|move)")), ignorenulls=True).over(upto), F.lit(False)))
    if symbols is not None:
        spans = symbols.filter(F.col("kind").isin("Function", "Method")).select("id", "path", "name", "line_start", "line_end")
        starts = rows.filter(F.col("code").rlike(r"async\s+(fn|move)")).select(F.col("path").alias("__p"), F.col("ln").alias("__l"), F.lit(True).alias("__async"))
        named = spans.join(starts, (F.col("path") == F.col("__p")) & (F.col("line_start") == F.col("__l")), "left").select(F.col("id").alias("span"), F.col("name").alias("fn"), F.coalesce("__async", F.lit(False)).alias("is_async"))
        rows = enclosing(rows.drop("fn", "is_async"), spans, "path", "ln", "line_start", "line_end", "id", 64).join(named, "span", "left").withColumn("is_async", F.coalesce("is_async", F.lit(False))).drop("span")
    safe_near = F.max(F.upper("line").contains("SAFETY").cast("int")).over(w.rowsBetween(-3, 0)) == 1
    in_tests = F.coalesce(F.max(F.col("line").contains("#[cfg(test)]").cast("int")).over(upto), F.lit(0)) == 1
    rows = rows.withColumn("documented", safe_near).withColumn("test", in_tests | is_test(F.col("path"))).withColumn("hot", F.coalesce(F.col("fn").rlike(HOT), F.lit(False)))
    live = rows.filter("not test and not " + "(ltrim(line) like '//%')")
    unsafe = F.col("code").rlike(r"\bunsafe\b") & ~F.col("code").rlike(r"unsafe (impl|trait)")
    made = lambda df, kind, severity, confidence, message: df.select("path", "ln", F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), F.lit(message).alias("message"))
    out = made(live.filter(unsafe), "UnsafeUsage", "Info", 0.95, "unsafe")
    out = out.unionByName(made(live.filter(unsafe & ~F.col("documented")), "MissingSafetyComment", "Low", 0.8, "unsafe without a SAFETY comment"))
    out = out.unionByName(made(rows.filter(F.col("is_async") & F.col("code").rlike(BLOCKING)), "BlockingInAsync", "Medium", 0.7, "blocking call in an async function"))
    out = out.unionByName(made(rows.filter(F.col("hot") & F.col("code").rlike(r"\.lock\(|\.lock_shared\(|\.write_arc\(|(Mutex|RwLock|guard).*\.(read|write)\(")), "LockOnHotPath", "Low", 0.55, "lock on a latency-sensitive path"))
    out = out.unionByName(made(live.filter(F.col("hot") & F.col("code").rlike(ALLOCATIONS)), "HotPathAllocation", "Info", 0.5, "allocation on a latency-sensitive path"))
    panic = live.filter(F.col("code").rlike(PANICS) & ~F.col("code").rlike(SAFE_UNWRAP) & (F.col("hot") | ~(F.col("code").rlike(r"\.expect\(") & ~F.col("code").rlike(r"\.unwrap\("))) & (F.col("hot") | ~F.coalesce(F.col("fn") == "main", F.lit(False))))
    out = out.unionByName(made(panic.filter("hot"), "PanicRisk", "Low", 0.75, "panic on a latency-sensitive path"))
    cold = capped(panic.filter("not hot").select("path", "ln"), ["path"], ["ln"], most_panics)
    out = out.unionByName(made(cold, "PanicRisk", "Info", 0.6, "panic path"))
    rest = cold.filter("more > 0").select("path", F.lit(1).alias("ln"), F.lit("PanicRisk").alias("kind"), F.lit("Info").alias("severity"), F.lit(0.6).alias("confidence"), F.concat(F.col("more").cast("string"), F.lit(" more panic paths")).alias("message"))
    compare = live.filter(F.col("code").rlike(r"[=!]=(?!=)") & F.col("code").rlike(SENSITIVE_NAME + r"\s*[=!]=|[=!]=\s*&?" + SENSITIVE_NAME) & ~F.col("code").rlike(SAFE_COMPARISON) & ~F.col("code").rlike(r'[=!]=\s*(true|false|None|"|[0-9]|[A-Z]\w*::)'))
    return out.unionByName(rest).unionByName(made(compare, "NonConstantTimeComparison", "Medium", 0.65, "comparison in variable time"))


def datagrams(lines: DataFrame) -> DataFrame:
    """Chunks beyond what a datagram holds, in files that use datagrams."""
    used = lines.filter(F.col("line").rlike(DATAGRAM)).select("path").distinct()
    constant = lines.filter(F.col("line").rlike(r"const\s+\w+\s*:\s*\w+\s*=\s*[0-9_]+")).select("path", F.regexp_extract("line", r"const\s+(\w+)", 1).alias("name"), F.regexp_replace(F.regexp_extract("line", r"=\s*([0-9_]+)", 1), "_", "").cast("long").alias("value"))
    constant = constant.groupBy("path", "name").agg(F.max("value").alias("value"))
    asked = lines.join(used, "path", "left_semi").select("path", "ln", F.regexp_extract("line", r"\.chunks(?:_exact)?\(\s*(\w+)\s*\)", 1).alias("arg")).filter("arg <> ''")
    size = F.coalesce(F.when(F.col("arg").rlike("^[0-9_]+$"), F.regexp_replace("arg", "_", "").try_cast("long")), F.col("value"))
    big = asked.join(constant.withColumnRenamed("name", "arg"), ["path", "arg"], "left").filter(size > LARGEST_DATAGRAM)
    return big.select("path", "ln", F.lit("OversizedDatagram").alias("kind"), F.lit("Medium").alias("severity"), F.lit(0.7).alias("confidence"), F.lit("chunk larger than a datagram").alias("message"))
