"""Graph operators over edge tables (src, dst).

Rounds over tables hold for graphs of any size.  A graph of at most SMALL edges, which
is counted first, is worked on by one task instead (localgraph.py), with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulint.operators import localgraph
from tabulint.plans.durable import saved

#: Edges and further nodes that one task takes: some tens of MB.
SMALL = 500_000


def is_small(*tables: DataFrame) -> bool:
    """Whether saved tables together have at most SMALL rows."""
    return sum(t.count() for t in tables) <= SMALL


def in_one_task(nodes: DataFrame, edges: DataFrame, work, column: str, kind: str) -> DataFrame:
    """(node, column): what work(n, src, dst, marked, shares) gives each node as a
    number, null to leave the node out.  Edges (src, dst[, share]) and nodes (node) go to
    one task, which numbers all names in order.  kind: the column's type, or `node` if its
    numbers are nodes."""
    name = edges.schema["src"].dataType.simpleString()
    share = F.col("share") if "share" in edges.columns else F.lit(1.0)
    rows = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), share.cast("double").alias("share"))
    rows = rows.unionAll(nodes.select(F.col("node").cast(name).alias("a"), F.lit(None).cast(name).alias("b"), F.lit(None).cast("double").alias("share")).filter("a is not null"))

    def run(parts):
        got = pa.Table.from_batches(parts, schema=None) if (parts := [*parts]) else None
        if got is None:
            return
        a, b, shares = (got.column(c).combine_chunks() for c in ("a", "b", "share"))
        every = pc.unique(pa.concat_arrays([a, b.drop_null()]))
        every = every.take(pc.sort_indices(every))
        number = lambda x: pc.index_in(x, every).to_numpy(zero_copy_only=False).astype(np.int64)
        edge = pc.is_valid(b)
        marked = number(a.filter(pc.invert(edge)))
        out = work(len(every), number(a.filter(edge)), number(b.filter(edge)), marked, shares.filter(edge).to_numpy(zero_copy_only=False)).astype(np.float64)
        keep = np.flatnonzero(~np.isnan(out))
        value = every.take(pa.array(out[keep].astype(np.int64))) if kind == "node" else pa.array(out[keep] if kind == "double" else out[keep].astype(np.int32))
        yield pa.RecordBatch.from_arrays([every.take(pa.array(keep)), value], names=["node", column])

    return rows.coalesce(1).mapInArrow(run, f"node {name}, {column} {name if kind == 'node' else kind}")


def shuffled(df: DataFrame) -> DataFrame:
    """df, joined by a shuffle of both sides: a table as long as the graph, though small
    as a file, would go through the driver, and again in every round."""
    return df.hint("merge")


def reachable(seeds: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, depth): nodes reached from the seeds (node), by breadth.

    Each round joins the frontier with the edges and takes off what is known; the
    frontier is written to the shared folder, so lineage stays short.  An error if
    `most_rounds` do not do.
    """
    kind = seeds.schema["node"].dataType
    e = saved(edges.select("src", "dst").filter("src is not null and dst is not null").distinct(), "edges")
    frontier = saved(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    if is_small(e, frontier):

        def work(n, src, dst, marked, _):
            d = localgraph.depths(n, src, dst, marked).astype(np.float64)
            return np.where(d < 0, np.nan, d)

        return in_one_task(frontier, e, work, "depth", "int").select(F.col("node").cast(kind).alias("node"), "depth")
    known = frontier
    for d in range(1, most_rounds + 1):
        step = frontier.join(shuffled(e), frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = saved(step.join(shuffled(known.select("node")), "node", "left_anti").withColumn("depth", F.lit(d)), "reach")
        if frontier.isEmpty():
            return known
        known = known.unionAll(frontier)
    raise RuntimeError(f"more than {most_rounds} steps from the seeds")


def impact(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): everything that leads to the targets, themselves left out."""
    return reachable(targets, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("depth > 0")


def bounded_paths(entries: DataFrame, edges: DataFrame, sinks: DataFrame, most_depth: int = 6, most_rows: int | None = 300) -> DataFrame:
    """(entry, sink, depth, path): a shortest path of at most `most_depth` edges
    from each entry to each sink, the least one among equals.  Sinks are leaves.
    most_rows keeps the first by (entry, sink), as a report does.  Only edges that lead
    to a sink in as many steps are walked."""
    e = saved(edges.select("src", "dst").distinct(), "edges")
    useful = impact(sinks.select("node"), e).filter(F.col("depth") <= most_depth).select("node").unionAll(sinks.select("node")).distinct()
    e = saved(e.join(useful.withColumnRenamed("node", "dst"), "dst", "left_semi"), "edges")
    leaf = sinks.select(F.col("node").alias("sink"))
    seen = saved(entries.select(F.col("node").alias("entry"), "node", F.array("node").alias("path")).distinct(), "paths")
    front, found = seen, None
    for d in range(1, most_depth + 1):
        step = front.join(e, front["node"] == e["src"]).select("entry", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("entry", "node").agg(F.min("path").alias("path")).join(seen.select("entry", "node"), ["entry", "node"], "left_anti")
        step = saved(step, "paths")
        seen = seen.select("entry", "node").unionAll(step.select("entry", "node"))
        hit = step.join(leaf, step["node"] == leaf["sink"]).select("entry", "sink", F.lit(d).alias("depth"), "path")
        found = hit if found is None else found.unionAll(hit)
        front = step.join(leaf, step["node"] == leaf["sink"], "left_anti")
        if front.isEmpty():
            break
    return found if most_rows is None else found.orderBy("entry", "sink").limit(most_rows)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 60) -> DataFrame:
    """(node, rank): power iteration with parallel edges counted and the rank of
    nodes without outgoing edges spread evenly.  Each round is written, so
    lineage stays short."""
    spark = nodes.sparkSession
    e = edges.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("k"))
    out = e.groupBy("src").agg(F.sum("k").alias("deg"))
    share = saved(e.join(shuffled(out), "src").select("src", "dst", (F.col("k") / F.col("deg")).alias("share")), "edges")
    base = saved(nodes.select("node").distinct(), "nodes")
    n = base.count()
    if is_small(share, base):

        def work(every, src, dst, _, shares):
            return localgraph.pagerank(every, src, dst, shares, damping, rounds)

        return in_one_task(base, share, work, "rank", "double").select(F.col("node").cast(nodes.schema["node"].dataType).alias("node"), "rank")
    rank = saved(base.join(shuffled(out.select(F.col("src").alias("node"), F.lit(False).alias("dangling"))), "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / max(n, 1)).alias("rank")), "ranks")
    for _ in range(rounds):
        # one number a round; as a part of the plan it would double the plan each time
        lost = rank.agg(F.sum(F.when(F.col("dangling"), F.col("rank")))).first()[0] or 0.0
        got = rank.join(shuffled(share), rank["node"] == share["src"]).select(F.col("dst").alias("node"), (damping * F.col("rank") * F.col("share")).alias("x"), F.lit(None).cast("boolean").alias("dangling"))
        every = rank.select("node", F.lit((1 - damping) / max(n, 1) + damping * lost / max(n, 1)).alias("x"), "dangling")
        rank = saved(every.unionAll(got).groupBy("node").agg(F.max("dangling").alias("dangling"), F.sum("x").alias("rank")), "ranks")
    return rank.select("node", "rank")


def strong_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, component), the least node of each strongly connected component.

    Colouring: every open node takes the greatest label that reaches it; within a
    colour, what reaches the colour's root backwards is its component; the rest
    goes into the next round.  Before each, nodes without an edge in or without one
    out are named, as they are alone.  An error if `most_rounds` do not do.
    """
    kind = nodes.schema["node"].dataType
    left = saved(nodes.select("node").distinct(), "open")
    live = saved(edges.filter("src <> dst").select("src", "dst").distinct(), "edges")
    if is_small(left, live):

        def work(n, src, dst, marked, _):
            out = np.full(n, np.nan)
            out[marked] = localgraph.components(n, src, dst)[marked]
            return out

        return in_one_task(left, live, work, "component", "node").select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
    done = None
    for r in range(most_rounds + 1):
        if left.isEmpty():
            break
        if r == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        inner = live.select(F.col("src").alias("node")).distinct().join(shuffled(live.select(F.col("dst").alias("node"))), "node", "left_semi")
        alone = saved(left.join(shuffled(inner), "node", "left_anti").select("node", F.col("node").alias("component")), "components")
        if not alone.isEmpty():
            done = alone if done is None else done.unionAll(alone)
            left = saved(left.join(shuffled(alone), "node", "left_anti"), "open")
            live = saved(live.join(shuffled(left.withColumnRenamed("node", "src")), "src").join(shuffled(left.withColumnRenamed("node", "dst")), "dst").select("src", "dst"), "edges")
            continue
        colour = saved(left.withColumn("colour", F.col("node")), "colours")
        while True:
            pushed = live.join(shuffled(colour), live["src"] == colour["node"]).select(F.col("dst").alias("node"), "colour")
            new = saved(colour.unionAll(pushed).groupBy("node").agg(F.max("colour").alias("colour")), "colours")
            same = new.join(shuffled(colour), ["node", "colour"], "left_anti").isEmpty()
            colour = new
            if same:
                break
        back = live.join(shuffled(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs"))), "src").join(shuffled(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd"))), "dst").filter("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        mine = reachable(colour.filter("node = colour").select("node"), back).select("node").join(shuffled(colour), "node")
        named = saved(mine.join(shuffled(mine.groupBy("colour").agg(F.min("node").alias("component"))), "colour").select("node", "component"), "components")
        done = named if done is None else done.unionAll(named)
        left = saved(left.join(shuffled(named), "node", "left_anti"), "open")
        live = saved(live.join(shuffled(left.withColumnRenamed("node", "src")), "src").join(shuffled(left.withColumnRenamed("node", "dst")), "dst").select("src", "dst"), "edges")
    return done if done is not None else nodes.select("node", F.col("node").alias("component"))


def cycles(components: DataFrame) -> DataFrame:
    """(component, size, members) of components of two nodes and more."""
    return components.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).filter("size > 1")


def layers(components: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(component, layer): longest path from a source component to it."""
    c = components
    across = edges.join(shuffled(c.select(F.col("node").alias("src"), F.col("component").alias("a"))), "src").join(shuffled(c.select(F.col("node").alias("dst"), F.col("component").alias("b"))), "dst").filter("a <> b").select("a", "b").distinct()
    across = saved(across, "edges")
    if is_small(across, saved(c.select("component").distinct(), "components")):
        kind = c.schema["component"].dataType

        def work(n, src, dst, *_):
            return localgraph.layers(n, src, dst)

        lone = c.select(F.col("component").alias("node")).distinct()
        return in_one_task(lone, across.select(F.col("a").alias("src"), F.col("b").alias("dst")), work, "layer", "int").select(F.col("node").cast(kind).alias("component"), "layer")
    layer = saved(c.select("component").distinct().withColumn("layer", F.lit(0)), "layers")
    for _ in range(most_rounds):
        push = across.join(shuffled(layer), across["a"] == layer["component"]).select(F.col("b").alias("component"), (F.col("layer") + 1).alias("layer"))
        new = saved(layer.unionAll(push).groupBy("component").agg(F.max("layer").alias("layer")), "layers")
        same = new.join(shuffled(layer), ["component", "layer"], "left_anti").isEmpty()
        layer = new
        if same:
            return layer
    raise RuntimeError(f"a path of more than {most_rounds} components")


def coupling(edges: DataFrame) -> DataFrame:
    """(node, ca, ce, instability): distinct nodes that depend on it, that it
    depends on, and ce over both, 0 without any."""
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    sides = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    out = sides.groupBy("node").agg(F.sum("i").alias("ca"), F.sum("o").alias("ce"))
    return out.withColumn("instability", F.col("ce") / (F.col("ca") + F.col("ce")))


def _articulation(pairs: list[tuple]) -> set:
    """Articulation points of one connected undirected graph, without recursion."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    found, order, low = set(), {}, {}
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        children, stack = 0, [(root, None, iter(sorted(set(near[root]))))]
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other == parent:
                    continue
                if other in order:
                    low[node] = min(low[node], order[other])
                else:
                    order[other] = low[other] = len(order)
                    children += node == root
                    stack.append((other, node, iter(sorted(set(near[other])))))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if parent != root and low[node] >= order[parent]:
                        found.add(parent)
        if children > 1:
            found.add(root)
    return found


def _communities(pairs: list[tuple], rounds: int) -> dict:
    """Label propagation in node order, each node taking its neighbours' most
    frequent label, the least among equals, from the labels as they stand."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {v: i for i, v in enumerate(sorted(near))}
    for _ in range(rounds):
        changed = False
        for v in sorted(near):
            votes: dict = {}
            for u in near[v]:
                votes[label[u]] = votes.get(label[u], 0) + 1
            best = min(votes, key=lambda x: (-votes[x], x))
            changed |= best != label[v]
            label[v] = best
        if not changed:
            break
    return label


def per_component(edges: DataFrame, what: str, rounds: int = 20) -> DataFrame:
    """Algorithms whose result depends on visiting order, run component by
    component: `articulation` gives (node), `community` gives (node, community),
    the least node with the label.  A component's edges must fit in one task:
    module graphs do; symbol graphs are projected to modules first."""
    from tabulint.operators.components import components

    kind = edges.schema["src"].dataType.simpleString()
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    roots = components(e.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    rows = e.join(shuffled(roots), e["src"] == roots["node"]).select("root", "src", "dst")

    def articulation(pdf):
        import pandas as pd

        return pd.DataFrame({"node": sorted(_articulation(list(zip(pdf["src"], pdf["dst"]))))}, dtype=object if kind == "string" else None)

    def community(pdf):
        import pandas as pd

        label = _communities(list(zip(pdf["src"], pdf["dst"])), rounds)
        least: dict = {}
        for v in sorted(label):
            least.setdefault(label[v], v)
        return pd.DataFrame({"node": list(label), "community": [least[x] for x in label.values()]})

    if what == "articulation":
        return rows.groupBy("root").applyInPandas(articulation, f"node {kind}")
    return rows.groupBy("root").applyInPandas(community, f"node {kind}, community {kind}")


def analysed(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The whole analysis of a directed graph, edges from a node to itself left out:
    coupling, rank, components, cycles, layers with the longest path (`depth`, one row),
    articulation points, communities, and the edges that lead from a layer to a higher
    one (violations)."""
    real = saved(edges.filter("src <> dst").select("src", "dst"), "edges")
    parts = saved(strong_components(nodes, real), "components")
    levels = saved(layers(parts, real), "layers")
    of = lambda c: shuffled(parts.join(shuffled(levels), "component").select(F.col("node").alias(c), F.col("layer").alias(f"{c}_layer")))
    across = real.distinct().join(of("src"), "src").join(of("dst"), "dst").filter("src_layer <> dst_layer")
    return {
        "coupling": coupling(real), "rank": pagerank(nodes, real), "components": parts, "cycles": cycles(parts), "layers": levels, "depth": levels.agg(F.coalesce(F.max("layer") + 1, F.lit(0)).alias("depth")),
        "violations": across, "articulation": per_component(real, "articulation"), "communities": per_component(real, "community"),
    }


def heaviest(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest distinct edges with their multiplicity."""
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "src", "dst").limit(k)


def transitions(rows: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """Edges between successive states of each group."""
    w = W.partitionBy(by).orderBy(*order)
    return rows.withColumn("dst", F.lead(state).over(w)).filter("dst is not null").select(F.col(state).alias("src"), "dst")
