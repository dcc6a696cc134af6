"""Joins: name resolution, endpoint linking, enclosing spans, suppression, baselines, advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tabulint.functions.scalar import affected, last_segment, path_pattern, without_api_prefix

#: The verbs that a route for any verb stands for.
VERBS = ("get", "post", "put", "patch", "delete")


def candidates(symbols: DataFrame, name: Column, group: Column, order: list[str]) -> DataFrame:
    """Per name and group: (name, n, id, group, n_local, local_id), of which a
    caller needs one row by name or by name and group."""
    s = symbols.select(name.alias("name"), group.alias("group"), F.struct(*order, "id").alias("o"), "id").filter("name is not null")
    return s.groupBy("name", "group").agg(F.count("*").alias("n_local"), F.min("o")["id"].alias("local_id"))


def resolve(calls: DataFrame, symbols: DataFrame, tiers: list[tuple[Column, Column]], order: list[str]) -> DataFrame:
    """calls (call_id, name, group[, owner]) with `target` and `tier`: the first tier
    that decides.  A tier is (key of a call, key of a symbol); it decides if one symbol
    has the key, or else just one symbol of the call's own group.  `owner`: what else of
    a call a key may name, as the class around it.

    Keys are looked up once per distinct call, and every tier's symbols are reduced to a
    row per key first, so a common name does not multiply rows.
    """
    by = [c for c in ("name", "group", "owner") if c in calls.columns]
    asked = calls.select(*by).distinct()
    picks = []
    for i, (call_key, symbol_key) in enumerate(tiers):
        local = candidates(symbols, symbol_key, F.col("group"), order).withColumnRenamed("name", "key")
        total = local.groupBy("key").agg(F.sum("n_local").alias("n"), F.min("local_id").alias("only"))
        asked = asked.withColumn("key", call_key).join(total, "key", "left").join(local, ["key", "group"], "left")
        asked = asked.withColumn(f"t{i}", F.when(F.col("n") == 1, F.col("only")).when(F.col("n_local") == 1, F.col("local_id"))).drop("key", "n", "only", "n_local", "local_id")
        picks.append(f"t{i}")
    tier = F.coalesce(*[F.when(F.col(p).isNotNull(), F.lit(i)) for i, p in enumerate(picks)])
    decided = asked.select(*[F.col(c).alias(f"__{c}") for c in by], F.coalesce(*picks).alias("target"), tier.alias("tier"))
    same = [calls[c].eqNullSafe(decided[f"__{c}"]) for c in by]
    return calls.join(decided, same, "left").drop(*[f"__{c}" for c in by])


#: How a call names its own object or class.
OWN = r"^(\$this->|this\.|self\.|self::|Self::|static::|parent::|super\.)"


def with_class(symbols: DataFrame) -> DataFrame:
    """symbols (id, kind, parent_id) with class_id: a class itself, else the symbol's
    parent."""
    return symbols.withColumn("class_id", F.when(F.col("kind") == "Class", F.col("id")).otherwise(F.col("parent_id")))


def method_tiers(symbols: DataFrame) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """(symbols with the keys of the tiers, tiers for resolve()) of object-oriented
    code: a method of the class around the call, named by way of the object itself; a
    method of a class named in the call, where one class only has that name; then the
    full name, the name, what follows the last separator, and the last two parts.

    symbols: (id, name, full_name, kind, parent_id, group, line_start); calls carry
    `owner`, the id of the class around them."""
    classes = symbols.filter("kind = 'Class'").groupBy("name").agg(F.count("*").alias("k"), F.min("id").alias("parent_id")).filter("k = 1").select("parent_id", F.col("name").alias("class_name"))
    s = symbols.join(classes, "parent_id", "left")
    last = last_segment(F.col("name"))
    parts = lambda c: F.split(F.regexp_replace(c, r"->|\\|\.", "::"), "::")
    two = lambda c: F.when(F.size(parts(c)) > 1, F.array_join(F.slice(parts(c), -2, 2), "::"))
    method = F.col("kind") == "Method"
    tiers = [
        (F.when(F.col("name").rlike(OWN), F.concat_ws("#", "owner", last)), F.when(method, F.concat_ws("#", "parent_id", "name"))),
        (F.when(F.size(parts(F.col("name"))) == 2, two(F.regexp_replace("name", r"^\$", ""))), F.when(method, F.concat_ws("::", "class_name", "name"))),
        (F.col("name"), F.col("full_name")),
        (F.col("name"), F.col("name")),
        (last, F.col("name")),
        (two(F.col("name")), two(F.col("full_name"))),
    ]
    return s, tiers


def link_endpoints(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """calls (call_seq, verb, path) with route_seq and match: the first route in
    order with the call's pattern and a fitting verb, else the first with both
    patterns stripped of their API prefix; null without one."""
    c = calls.withColumn("p", path_pattern(F.col("path")))
    # the first route of each pattern and verb is all that a call can get
    r = routes.select("route_seq", F.col("verb").alias("rv"), path_pattern(F.col("path")).alias("p")).groupBy("p", "rv").agg(F.min("route_seq").alias("route_seq"))
    fits = (F.col("rv") == F.col("verb")) | (F.col("rv") == "any") | (F.col("verb") == "any")
    exact = c.join(r, "p").filter(fits).select("call_seq", F.lit(0).alias("tier"), "route_seq")
    cd, rd = c.withColumn("p", without_api_prefix(F.col("p"))).filter("p <> ''"), r.withColumn("p", without_api_prefix(F.col("p"))).filter("p <> ''").groupBy("p", "rv").agg(F.min("route_seq").alias("route_seq"))
    loose = cd.join(rd, "p").filter(fits).select("call_seq", F.lit(1).alias("tier"), "route_seq")
    best = exact.unionAll(loose).groupBy("call_seq").agg(F.min(F.struct("tier", "route_seq")).alias("b"))
    how = F.when(F.col("b.tier") == 0, "exact").when(F.col("b.tier") == 1, "prefix")
    return calls.join(best, "call_seq", "left").select(*calls.columns, F.col("b.route_seq").alias("route_seq"), how.alias("match"))


def reconcile(calls: DataFrame, routes: DataFrame) -> dict[str, DataFrame]:
    """links: link_endpoints(); orphan_calls: calls without a route; orphan_routes: routes
    that no call gets; counts: one row (matched, orphan_calls, orphan_routes)."""
    linked = link_endpoints(calls, routes)
    lonely = routes.join(linked.filter("route_seq is not null").select("route_seq").distinct(), "route_seq", "left_anti")
    counts = linked.agg(F.count("route_seq").alias("matched"), F.count_if(F.col("route_seq").isNull()).alias("orphan_calls"))
    return {"links": linked, "orphan_calls": linked.filter("route_seq is null"), "orphan_routes": lonely, "counts": counts.join(lonely.agg(F.count("*").alias("orphan_routes")))}


def endpoint_keys(routes: DataFrame) -> DataFrame:
    """(key, route_seq): `verb pattern` of every verb a route serves."""
    verbs = F.when(F.col("verb") == "any", F.array(*map(F.lit, VERBS))).otherwise(F.array("verb"))
    return routes.select("route_seq", F.explode(verbs).alias("v"), path_pattern(F.col("path")).alias("p")).select(F.concat_ws(" ", "v", "p").alias("key"), "route_seq")


def enclosing(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str, span_id: str, bin_size: int) -> DataFrame:
    """points with the narrowest span of their group that covers them (inverted
    spans cover nothing); ties go to the earliest start, end, then the least id.

    Whole numbers: a span is cut into blocks of one, two, four and so on places, of which
    the narrowest span is kept, and a place looks its own block of each size up, so no
    span meets each place in it.  Other numbers: both sides are cut into bins of
    `bin_size`, and a long span stands in the bins it covers only.  A point without a
    group or a place has no span.
    """
    # of equal spans the least id is all that a place can get
    s = spans.filter(F.col(end) >= F.col(start)).groupBy(F.col(group).alias("__g"), F.col(start).alias("a"), F.col(end).alias("z")).agg(F.min(span_id).alias("id"))
    s = s.select("__g", F.struct((F.col("z") - F.col("a")).alias("w"), "a", "z", "id").alias("__s"))
    # the narrowest span is looked for once per distinct place
    places = points.select(F.col(group).alias("__g"), F.col(at).alias("__at")).distinct()
    if all(isinstance(df.schema[c].dataType, IntegralType) for df, c in ((points, at), (spans, start), (spans, end))):
        sizes = lambda w: F.sequence(F.lit(0), F.floor(F.log2(w.cast("double") + 1)).cast("int") + 1)
        first, after = F.expr("shiftright(cast(__s.a as bigint) - 1, __k) + 1"), F.expr("shiftright(cast(__s.z as bigint) + 1, __k)")
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        s = s.select("*", F.explode(sizes(F.col("__s.w"))).alias("__k")).select("*", first.alias("__l"), after.alias("__r")).filter("__l < __r")
        blocks = F.array(F.when(odd(F.col("__l")), F.col("__l")), F.when(odd(F.col("__r")), F.col("__r") - 1))
        s = s.select("__g", "__s", "__k", F.explode(blocks).alias("__bin")).filter("__bin is not null").groupBy("__g", "__k", "__bin").agg(F.min("__s").alias("__s"))
        widest = spans.filter(F.col(end) >= F.col(start)).agg(F.max(F.col(end) - F.col(start)).alias("__w"))
        places = places.join(F.broadcast(widest)).select("__g", "__at", F.explode(sizes(F.col("__w"))).alias("__k")).withColumn("__bin", F.expr("shiftright(cast(__at as bigint), __k)"))
        inside = places.join(s, ["__g", "__k", "__bin"])
    else:
        b = lambda c: F.floor(F.col(c) / bin_size)
        s = s.select("__g", "__s", F.explode(F.sequence(b("__s.a"), b("__s.z"))).alias("__bin"))
        inside = places.withColumn("__bin", b("__at")).join(s, ["__g", "__bin"]).filter((F.col("__at") >= F.col("__s.a")) & (F.col("__at") <= F.col("__s.z")))
    best = inside.groupBy("__g", "__at").agg(F.min("__s").alias("__b"))
    return points.join(best, (points[group] == best["__g"]) & (points[at] == best["__at"]), "left").select(*points.columns, F.col("__b.id").alias("span"))


def suppress(findings: DataFrame, sites: DataFrame, file: str = "file", line: str = "line") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, suppressed, stale sites).  A site (file, ln, kinds) covers its own and
    the next line, for the kinds it lists or, with null, for all; a finding on line
    0 cannot be suppressed; a site that covers no finding is stale."""
    reach = sites.select(F.col(file).alias("__f"), "ln", "kinds", F.explode(F.array(F.col("ln"), F.col("ln") + 1)).alias("__l"))
    on = (findings[file] == reach["__f"]) & (findings[line] == reach["__l"]) & (findings[line] > 0) & (reach["kinds"].isNull() | F.array_contains(reach["kinds"], findings["kind"]))
    used = findings.join(reach, on).select(F.col("__f"), "ln").distinct()
    stale = sites.join(used, (sites[file] == used["__f"]) & (sites["ln"] == used["ln"]), "left_anti")
    return findings.join(reach, on, "left_anti"), findings.join(reach, on, "left_semi"), stale


def baseline_diff(current: DataFrame, baseline: DataFrame, baselineable: Column) -> dict[str, DataFrame]:
    """new: baselineable findings whose fingerprint the baseline lacks; existing:
    those it has; resolved: baseline rows that no current finding has."""
    base, now = baseline.select("fingerprint").distinct(), current.select("fingerprint").distinct()
    ours = current.filter(baselineable)
    return {"new": ours.join(base, "fingerprint", "left_anti"), "existing": ours.join(base, "fingerprint", "left_semi"), "resolved": baseline.join(now, "fingerprint", "left_anti")}


def advisories(locked: DataFrame, known: DataFrame) -> DataFrame:
    """Packages (name, version struct) that an advisory (package, patched) applies to."""
    return locked.join(known, locked["name"] == known["package"]).filter(affected(F.col("version"), F.col("patched")))


def lookup(symbols: DataFrame, query: str, full: str = "full_name", name: str = "name") -> DataFrame:
    """Symbols by full name, else by name, else by a part of the full name in any
    case: the rows of the first tier that has some."""
    tier = F.when(F.col(full) == query, 0).when(F.col(name) == query, 1).when(F.contains(F.lower(full), F.lit(query.lower())), 2)
    hit = symbols.withColumn("tier", tier).filter("tier is not null")
    best = hit.agg(F.min("tier").alias("best"))
    return hit.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def lookup_one(symbols: DataFrame, query: str, most: int = 10, full: str = "full_name", name: str = "name") -> DataFrame:
    """The one symbol that lookup() finds; an error that lists the first ones if there
    are several, or if there is none."""
    found = lookup(symbols, query, full, name)
    first = [r[full] for r in found.orderBy(full).limit(most + 1).collect()]
    if len(first) != 1:
        raise LookupError(f"{query!r} names no symbol" if not first else f"{query!r} may be any of {', '.join(first[:most])}" + " and more" * (len(first) > most))
    return found


def deoverlapped(spans: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans of a group merged where they overlap: gaps and islands by a running
    maximum of the ends before."""
    w = W.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(group, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("spans"))
