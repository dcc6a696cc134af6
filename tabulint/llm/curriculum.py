"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, linear between
knots.  The integral of the schedule, scaled to the source's target, is its
cumulative token demand.  A source's documents stand in an order given by a hash;
the middle of a document's stretch of tokens, put through the inverse of the
cumulative demand, is its training position.  A source whose target exceeds its
size starts over, so a document can have several positions.  Sorting by position
by range gives the training order.

Running totals over a large source are made in two steps: totals of hash buckets,
then a running total inside each bucket, so no task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulint.llm.textkit import WORD

#: Hex digits of the hash that name a bucket, so 4,096 buckets a source.
BUCKET_DIGITS = 3
#: Schedules by the source's rank modulo their number: rising, level, falling.
RAMPS = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """sizes: (source, source_size, ...), a row a source.  Adds rank (0 for the
    first source by code point, nulls last), weight and target: the total of all
    sizes shared by weight, no source above `most` times its size, what is above
    given to the others by weight until none is above.

    Sorted by size over weight, the sources that stop at their limit come first,
    so the level of the others follows from running totals: no iteration.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_source) - 1).withColumn("weight", w)
    fill = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank").asc())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranked = ranked.withColumns(
        {
            "level": (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        }
    )
    # the first source in fill order that its level does not bring to its limit
    settled = F.min(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything)
    level = settled["level"]
    return ranked.withColumn("target", F.coalesce(F.least(most * F.col("source_size"), level * F.col("weight")), most * F.col("source_size")).cast("double")).drop("level")


def demand_inverse(share: Column, schedule: Column) -> Column:
    """Time at which a schedule's integral reaches `share` (0 to 1) of its whole.

    schedule: array<struct<t, w>> of knots by rising t.  Between two knots the
    integral is a parabola, so its inverse is the root of a quadratic, written in
    the form that also holds for a level weight.
    """
    n = F.size(schedule)
    parts = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(
            F.element_at(schedule, i)["t"].alias("t"),
            (F.element_at(schedule, i + 1)["t"] - F.element_at(schedule, i)["t"]).alias("dt"),
            F.element_at(schedule, i)["w"].alias("a"),
            F.element_at(schedule, i + 1)["w"].alias("b"),
        ),
    )
    area = lambda p: p["dt"] * (p["a"] + p["b"]) / 2
    whole = F.aggregate(parts, F.lit(0.0), lambda s, p: s + area(p))

    def step(s, p):
        inside = s["left"] <= area(p)
        slope = (p["b"] - p["a"]) / F.when(p["dt"] > 0, p["dt"]).otherwise(F.lit(1.0))
        root = 2 * s["left"] / F.greatest(p["a"] + F.sqrt(F.greatest(p["a"] * p["a"] + 2 * slope * s["left"], F.lit(0.0))), F.lit(1e-12))
        return F.struct((s["left"] - area(p)).alias("left"), F.coalesce(s["t"], F.when(inside, p["t"] + F.least(root, p["dt"]))).alias("t"))

    end = F.element_at(schedule, -1)["t"]
    return F.aggregate(parts, F.struct((share * whole).alias("left"), F.lit(None).cast("double").alias("t")), step, lambda s: F.coalesce(s["t"], end))


def schedules(ramps: tuple) -> Column:
    """The schedule of a source by its rank."""
    knots = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in r]) for r in ramps])
    return F.element_at(knots, (F.col("rank") % len(ramps) + 1).cast("int"))


def assign(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, ramps: tuple = RAMPS, doc_id: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per document with doc_id, source, size (words), source_size, target,
    taken (words that the mix takes, repeats counted) and positions (training
    times, one per copy taken), and the `keep` columns.

    A source's documents, in hash order and over again, are taken as long as the
    tokens before a copy's middle are under the target, so what is taken is off
    by half a document at most.  Documents of no words are never taken.  A null
    source is a source.  Repeated rows each count; ties in the hash go by doc_id,
    and equal rows are interchangeable.  An empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *keep)
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # one column names a source's bucket, so that the join and the running totals are dealt out alike
    cell = F.concat("bucket", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    rows = rows.withColumn("order", order).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS)).withColumn("cell", cell)
    totals = rows.groupBy("source", "bucket", "cell").agg(F.sum("size").alias("bucket_size"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)))
    sources = targets(totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    s, t = starts.alias("s"), sources.alias("t")
    ready = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.cell", "s.bucket_start", "t.rank", "t.source_size", "t.target")
    r, k = rows.alias("r"), ready.alias("k")
    within = W.partitionBy("cell").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        r.join(k, F.col("r.cell") == F.col("k.cell"))
        .select("r.doc_id", "r.source", "r.cell", "r.order", "r.size", *(F.col(f"r.{c}") for c in keep), "k.bucket_start", "k.rank", "k.source_size", "k.target")
        .withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    )
    middle = F.col("start") + F.col("size") / 2
    copies = F.filter(F.sequence(F.lit(0), F.lit(int(most) - 1)), lambda c: (F.col("size") > 0) & (c * F.col("source_size") + middle < F.col("target")))
    placed = placed.withColumn("copies", copies)
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.size("copies") * F.col("size")).alias("taken"),
        F.transform("copies", lambda c: demand_inverse((c * F.col("source_size") + middle) / F.col("target"), schedules(ramps))).alias("positions"),
        *keep,
    )


def training_order(assigned: DataFrame) -> DataFrame:
    """A row per copy taken, with its position, range-sorted by it."""
    copies = assigned.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return copies.repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id", "copy")
