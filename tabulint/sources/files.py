"""File trees and the small file formats that analyses read."""

from __future__ import annotations

import fnmatch
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulint.functions.scalar import file_name, fnv1a64

#: Larger files are not read.
LARGEST = 5 * 1024 * 1024
# Languages by extension and build directories that are skipped.
LANGUAGES = {"php": "Php", "rs": "Rust", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "py": "Python", "go": "Go", "java": "Java", "html": "JavaScript", "htm": "JavaScript"}
SKIPPED = r"(^|/)(\.git|vendor|node_modules|target|dist|build|\.next|coverage)(/|$)"


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    name = file_name(path)
    by_ext = F.coalesce(*[F.when(ext == e, F.lit(lang)) for e, lang in LANGUAGES.items()])
    infra = F.when((name == "Dockerfile") | name.startswith("Dockerfile."), "Dockerfile").when(ext == "tf", "Terraform").when(ext.isin("yaml", "yml"), "Yaml")
    return F.coalesce(by_ext, infra)


def is_kept(rel: Column, exclude: tuple[str, ...] = ()) -> Column:
    """Whether a relative path is read: no build output, no minified script, no view
    template, none of the parts to exclude."""
    keep = ~rel.rlike(SKIPPED) & ~rel.rlike(r"\.min\.(js|css)$") & ~rel.endswith(".blade.php")
    for part in exclude:
        keep = keep & ~rel.contains(part)
    return keep


def readable(content: Column) -> Column:
    """Bytes as text; lines that are not UTF-8 become empty."""
    text = content.cast("string")
    # splitting puts the replacement character where bytes are no text
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(x.contains("\ufffd"), F.lit("")).otherwise(x))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.array_join(lines, "\n"))


def hidden_text(spark: SparkSession, root: str, name: str) -> str | None:
    """Text of a file that Spark's readers pass over for its name; None without one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root, name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """files (path, file_id, lang, size_bytes, hash, text) of a tree by any Hadoop path.

    Paths and lengths are listed first, without the contents; filters on paths, size and
    the tree's own .gitignore leave the paths that are then read, so that nothing else
    is.  Binary and minified files are dropped by their contents.  The driver holds the
    paths of a tree, as Spark's own listing does; like that it passes over hidden files."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + base.split("://")[-1].replace(".", r"\."), "")
    rel = F.regexp_replace(path, "^/+", "")
    patterns = (hidden_text(spark, root, ".gitignore") or "").splitlines()
    kept = listing.filter(F.col("length") <= LARGEST).select("path", rel.alias("rel"))
    names = [r["path"] for r in kept.filter(is_kept(F.col("rel"), exclude)).collect() if not ignored(r["rel"], patterns)]
    raw = spark.read.format("binaryFile").load(names) if names else listing.limit(0)
    files = raw.withColumn("rel", rel).withColumn("lang", language(F.col("rel")))
    head = F.decode(F.substring("content", 1, 8192), "ISO-8859-1")
    files = files.filter(F.instr(head, "\u0000") == 0).withColumn("text", readable(F.col("content")))
    longest = F.array_max(F.transform(F.split(F.substring("text", 1, 65536), "\n"), F.length))
    minified = (F.col("lang").isin("JavaScript", "TypeScript") | F.col("rel").endswith(".css")) & (longest > 5000)
    files = files.filter(~F.coalesce(minified, F.lit(False)))
    return files.select(F.col("rel").alias("path"), fnv1a64(F.col("rel")).alias("file_id"), "lang", F.col("length").alias("size_bytes"), F.xxhash64("content").alias("hash"), "text")


def ignored(path: str, patterns: list[str]) -> bool:
    """Whether .gitignore-like lines exclude a path: the last line that fits decides,
    `!` takes back, `/` anchors, a final `/` names folders.  A driver-side filter of
    a listing; character ranges and escapes are as in fnmatch."""
    out, parts = False, path.split("/")
    for line in patterns:
        p = line.rstrip()
        if not p or p.startswith("#"):
            continue
        back = p.startswith("!")
        p = p[1:] if back else p
        folder, p = p.endswith("/"), p.rstrip("/")
        ends = range(1, len(parts) + (not folder))
        if "/" in p:
            p = p.lstrip("/")
            hit = any(fnmatch.fnmatchcase("/".join(parts[:k]), p.replace("**/", "*")) for k in ends)
        else:
            hit = any(fnmatch.fnmatchcase(parts[k - 1], p) for k in ends)
        if hit:
            out = not back
    return out


def main_language(files: DataFrame) -> DataFrame:
    """One row (lang, votes): files by language, with a bonus for its manifest."""
    order = ["Rust", "Php", "TypeScript", "JavaScript", "Python", "Go"]
    name = file_name(F.col("path"))
    bonus = {"Cargo.toml": {"Rust": 10}, "composer.json": {"Php": 10}, "package.json": {"JavaScript": 5, "TypeScript": 5}, "go.mod": {"Go": 10}, "pyproject.toml": {"Python": 10}, "requirements.txt": {"Python": 10}}
    pairs = [F.when(F.col("lang") == v, F.struct(F.lit(v).alias("lang"), F.lit(1).alias("n"))) for v in order]
    pairs += [F.when(name == m, F.struct(F.lit(v).alias("lang"), F.lit(n).alias("n"))) for m, votes in bonus.items() for v, n in votes.items()]
    votes = files.select(F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("v")).groupBy("v.lang").agg(F.sum("v.n").alias("votes"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("lang"))
    return votes.orderBy(F.desc("votes"), rank).limit(1)


def framework(files: DataFrame) -> DataFrame:
    """One row (framework): by what the manifest requires, else by the files of a
    blog system, else Unknown."""
    requires = F.when(F.col("path") == "composer.json", F.get_json_object("text", "$.require"))
    keys = F.json_object_keys(requires)
    has = lambda *names: F.coalesce(F.max(F.arrays_overlap(keys, F.array(*map(F.lit, names)))), F.lit(False))
    blog = F.coalesce(F.max((F.col("path") == "wp-config.php") | F.col("path").startswith("wp-content/")), F.lit(False))
    manifest = F.coalesce(F.max(F.col("path") == "composer.json"), F.lit(False))
    name = F.when(has("laravel/framework"), "Laravel").when(has("symfony/framework-bundle", "symfony/symfony"), "Symfony").when(manifest & blog, "WordPress").otherwise("Unknown")
    return files.agg(name.alias("framework"))


def lcov(lines: DataFrame, file: str = "report") -> DataFrame:
    """(report, path, ln or function, hits) of coverage lines (report, ln, line).
    The file a record belongs to is carried forward within its report; a record
    outside one, or a bad number, fails the query with its line number."""
    w = W.partitionBy(file).orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    t = F.trim("line")
    key = F.regexp_extract(t, "^([A-Z]+):", 1)
    value = F.regexp_replace(t, "^[A-Z]+:", "")
    section = F.last(F.when(key == "SF", value).when(t == "end_of_record", F.lit("")), ignorenulls=True).over(w)
    rows = lines.withColumn("key", key).withColumn("value", value).withColumn("path", section).filter(F.col("key").isin("DA", "FN", "FNDA"))
    bad = (F.coalesce("path", F.lit("")) == "") | ((F.col("key") == "DA") & ~F.col("value").rlike(r"^[0-9]+,[0-9]+")) | ((F.col("key") == "FNDA") & ~F.col("value").rlike(r"^[0-9]+,.+"))
    number = F.when(bad, F.raise_error(F.concat(F.lit("bad coverage record on line "), F.col("ln").cast("string"))).cast("long"))
    at = F.when(F.col("key") == "DA", F.regexp_extract("value", "^([0-9]+)", 1).cast("long"))
    hits = F.when(F.col("key") == "DA", F.regexp_extract("value", "^[0-9]+,([0-9]+)", 1).cast("long")).when(F.col("key") == "FNDA", F.regexp_extract("value", "^([0-9]+),", 1).cast("long")).otherwise(F.lit(0))
    name = F.when(F.col("key") == "FN", F.regexp_replace("value", r"^[0-9]+(,[0-9]+)?,", "")).when(F.col("key") == "FNDA", F.regexp_replace("value", "^[0-9]+,", ""))
    rows = rows.select(file, "path", at.alias("line"), name.alias("function"), F.coalesce(number, hits).alias("hits"))
    return rows.groupBy(file, "path", "line", "function").agg(F.max("hits").alias("hits"))


def cargo_lock(lines: DataFrame, file: str = "path") -> DataFrame:
    """(path, name, version) of the [[package]] blocks of lock files."""
    w = W.partitionBy(file).orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    block = F.sum(F.when(F.trim("line") == "[[package]]", 1).otherwise(0)).over(w)
    field = lambda k: F.max(F.when(F.col("line").rlike(rf'^\s*{k}\s*=\s*"'), F.regexp_extract("line", '"(.*)"', 1))).alias(k)
    return lines.withColumn("block", block).filter("block > 0").groupBy(file, "block").agg(field("name"), field("version")).filter("name is not null and version is not null").drop("block")


def toml_dependencies(lines: DataFrame, file: str = "path") -> DataFrame:
    """(path, name) of all `*dependencies` tables of manifests."""
    w = W.partitionBy(file).orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    header = F.regexp_extract(F.trim("line"), r"^\[+([^\]]+)\]+", 1)
    rows = lines.withColumn("h", header).withColumn("table", F.last(F.when(F.col("h") != "", F.col("h")), ignorenulls=True).over(w))
    inline = rows.filter((F.col("h") == "") & F.col("table").rlike("dependencies$")).select(file, F.regexp_extract("line", r'^\s*"?([A-Za-z0-9_-]+)"?\s*[=.]', 1).alias("name"))
    own = rows.filter(F.col("h").rlike(r"dependencies\.[A-Za-z0-9_-]+$")).select(file, F.regexp_extract("h", r"dependencies\.([A-Za-z0-9_-]+)$", 1).alias("name"))
    return inline.unionAll(own).filter("name <> ''").distinct()


def yaml_documents(lines: DataFrame, file: str = "path") -> DataFrame:
    """(path, doc, first_ln, text): the documents of YAML files."""
    w = W.partitionBy(file).orderBy("ln").rowsBetween(W.unboundedPreceding, 0)
    mark = F.col("line").rlike(r"^---(\s|$)")
    rows = lines.withColumn("doc", F.sum(mark.cast("int")).over(w)).filter(~mark)
    out = rows.groupBy(file, "doc").agg(F.min("ln").alias("first_ln"), F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("body"))
    return out.select(file, "doc", "first_ln", F.array_join(F.transform("body", lambda x: x["line"]), "\n").alias("text")).filter(F.trim("text") != "")


def baseline(text: str) -> list[tuple[str, str | None]]:
    """(fingerprint, kind) of a baseline file in its second or first form; anything
    else is an error."""
    data = json.loads(text)
    if isinstance(data.get("findings"), list):
        rows = [(f["fingerprint"], f.get("kind")) for f in data["findings"]]
    elif isinstance(data.get("fingerprints"), list):
        rows = [(f, None) for f in data["fingerprints"]]
    else:
        raise ValueError("a baseline holds findings or fingerprints")
    if any(not f for f, _ in rows):
        raise ValueError("a baseline entry has no fingerprint")
    return rows


def list_tree(root: str) -> list[str]:
    """Relative paths of a local tree that its own .gitignore keeps, sorted."""
    patterns: list[str] = []
    top = os.path.join(root, ".gitignore")
    if os.path.exists(top):
        with open(top, encoding="utf-8") as f:
            patterns = f.read().splitlines()
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d != ".git"]
        for n in names:
            p = os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/")
            if not ignored(p, patterns):
                out.append(p)
    return sorted(out)
