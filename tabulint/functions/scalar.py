"""Scalar functions over names, paths, URLs, versions and text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments and markers of files that are not shipped code.
AUXILIARY_SEGMENTS = (
    "test", "tests", "__tests__", "spec", "specs", "example", "examples", "sample", "samples", "vendor", "node_modules", "benches", "bench", "testdata", "mocks",
    "dist", "build", "target", "generated", "third_party", "third-party", "external", "public", "static", "assets", "plugins",
)
AUXILIARY_MARKERS = ("_test.", ".test.", ".spec.", "_spec.", ".min.js", ".pb.go", "_pb2.py", ".generated.")
TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "specs")
TEST_MARKERS = ("_test.", ".test.", ".spec.", "_spec.")


def fnv1a64(value: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 hex digits, in two 32-bit halves so that
    nothing overflows under ANSI arithmetic."""
    mask = (1 << 32) - 1
    octets = F.filter(F.regexp_extract_all(F.hex(F.encode(value, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda x: x != "")

    def step(s: Column, x: Column) -> Column:
        low = s["lo"].bitwiseXOR(F.conv(x, 16, 10).cast("long"))
        high = s["hi"] * 435 + low.bitwiseAND(0xFFFFFF) * 256 + F.shiftright(low * 435, 32)
        return F.struct(high.bitwiseAND(mask).alias("hi"), (low * 435).bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(3421674724).cast("long").alias("hi"), F.lit(2216829733).cast("long").alias("lo"))
    return F.aggregate(octets, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))


def any_contains(value: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | value.contains(n)
    return out


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def top_dir(path: Column) -> Column:
    """First directory of a relative path, `.` for files at the root."""
    p = slashes(path)
    return F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(F.lit("."))


def is_auxiliary(path: Column) -> Column:
    """Whether a path is tests, vendored, generated or served code; the repository's
    own tests/fixtures never are."""
    p = slashes(path)
    segments = F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, AUXILIARY_SEGMENTS)))
    return ~p.contains("tests/fixtures") & (segments | any_contains(p, AUXILIARY_MARKERS))


def is_test(path: Column) -> Column:
    p, name = slashes(path), file_name(path)
    segments = F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, TEST_SEGMENTS)))
    return ~p.contains("tests/fixtures") & (segments | any_contains(name, TEST_MARKERS) | name.startswith("test_") | (name == "conftest.py"))


def path_pattern(url: Column) -> Column:
    """Route pattern of a path: query and fragment dropped, slashes trimmed,
    parameters and numbers replaced by `*`."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), r"^/+|/+$", "")
    dynamic = lambda s: s.startswith("{") | s.startswith(":") | s.contains("${") | s.rlike(r"^[0-9]+$")
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(dynamic(s), F.lit("*")).otherwise(s)), "/")


def without_api_prefix(pattern: Column) -> Column:
    """A pattern without a leading `api/` and the version that follows it."""
    rest = F.regexp_replace(pattern, r"^api/", "")
    tail = F.when(rest.rlike(r"^v[0-9]+$"), F.lit("")).otherwise(F.regexp_replace(rest, r"^v[0-9]+/", ""))
    return F.when(pattern.startswith("api/"), tail).otherwise(pattern)


def last_segment(name: Column) -> Column:
    """What follows the last of the separators \\, ::, ->, and dot."""
    return F.regexp_extract(name, r"([^\\:>.]*)$", 1)


def split_words(name: Column) -> Column:
    """Words of a name, cut at underscores and before capitals."""
    return F.filter(F.split(F.regexp_replace(name, r"(?<=[^_])(?=\p{Lu})", "_"), "_"), lambda w: w != "")


def _title(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def to_pascal(name: Column) -> Column:
    return F.array_join(F.transform(split_words(name), _title), "")


def to_camel(name: Column) -> Column:
    p = to_pascal(name)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))


def to_snake(name: Column) -> Column:
    return F.array_join(F.transform(split_words(name), F.lower), "_")


def to_screaming(name: Column) -> Column:
    return F.array_join(F.transform(split_words(name), F.upper), "_")


def convention_ok(name: Column, convention: Column) -> Column:
    """Whether a name keeps its convention: pascal, camel, snake or screaming."""
    return (
        F.when(convention == "pascal", name.rlike(r"^\p{Lu}[^_]*$"))
        .when(convention == "camel", name.rlike(r"^\p{Ll}[^_]*$"))
        .when(convention == "snake", name.rlike(r"^[\p{L}\p{N}]+(_[\p{L}\p{N}]+)*$") & ~name.rlike(r"\p{Lu}"))
        .when(convention == "screaming", name.rlike(r"^[\p{L}\p{N}_]+$") & ~name.rlike(r"\p{Ll}"))
    )


def version(text: Column) -> Column:
    """struct<major, minor, patch> of a version, null if it is none; what follows
    - or + does not count and missing parts are 0."""
    core = F.regexp_extract(text, r"^[^-+]*", 0)
    part = lambda k: F.coalesce(F.get(F.split(core, r"\."), F.lit(k)), F.lit("0")).cast("long")
    return F.when(core.rlike(r"^[0-9]+(\.[0-9]+){0,2}(\..*)?$"), F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch")))


def affected(locked: Column, patched: Column) -> Column:
    """Whether a version is below the patched one on its compatibility line: the
    minor of 0.x releases, else the major.  Without a patched one all are."""
    line = F.when(patched["major"] == 0, (locked["major"] == 0) & (locked["minor"] == patched["minor"])).otherwise(locked["major"] == patched["major"])
    return F.when(patched.isNull(), F.lit(True)).otherwise(line & (locked < patched))


def without_digits(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[0-9]", ""))


def is_comment_line(text: Column) -> Column:
    return text.rlike(r"^\s*(//|\*|#)")


def without_line_comment(text: Column) -> Column:
    return F.regexp_replace(text, r"//.*$", "")


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to one decimal, 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(F.lit(0.0))
