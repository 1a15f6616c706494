"""Directed graphs as edge tables (src, dst): degrees, barrels, components, cycles.

Loops run until nothing changes; each round is written to the shared checkpoint folder, so lineage
stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.ranks import with_percentile
from heddle.operators.saving import maybe_broadcast, release, saved

#: Neighbours in one list.
LIST = 10_000


def edges_of(rows: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct (src, dst) without self edges and nulls."""
    return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of every node with an edge."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def hubs(edges: DataFrame) -> DataFrame:
    """degrees() with their sum and the percentile of fan_in among all nodes."""
    return with_percentile(degrees(edges).withColumn("total", F.col("fan_in") + F.col("fan_out")), "fan_in", "fan_in_pct")


def through_barrels(edges: DataFrame, barrels: DataFrame) -> DataFrame:
    """edges and, one hop on, what the barrels among the targets depend on; barrels: (node). A barrel needs an edge of its own."""
    onward = edges.join(barrels.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("barrel"), F.col("dst").alias("to"))
    hop = edges.join(onward, F.col("dst") == F.col("barrel")).select("src", F.col("to").alias("dst")).where("src <> dst")
    return edges.select("src", "dst").unionByName(hop).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def with_edge(pairs: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs that an edge joins in either direction."""
    e = symmetric(edges)
    return pairs.join(e, (pairs[a] == e["src"]) & (pairs[b] == e["dst"]), "left_semi")


def without_edge(pairs: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs that no edge joins."""
    e = symmetric(edges)
    return pairs.join(e, (pairs[a] == e["src"]) & (pairs[b] == e["dst"]), "left_anti")


def neighbours(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, direction) one hop from own (node), own nodes excluded."""
    o = own.select("node").distinct()
    out = edges.join(o, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node"), F.lit("out").alias("direction"))
    into = edges.join(o, F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("node"), F.lit("in").alias("direction"))
    return out.unionByName(into).distinct().join(o, "node", "left_anti")


def weak_components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (a, b): the component's smallest node. Labels spread, then jump."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "node")
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = saved(step.join(up, "component").select("node", "old", F.least("component", "up").alias("component")))
        labels, done = after.select("node", "component"), after.where("old <> component").isEmpty()
        del near, step, up, after
        if done:
            release(links.sparkSession)
            return labels


def _lists(edges: DataFrame, key: str, other: str) -> DataFrame:
    """(node, others): every node's neighbours in lists of about LIST at most, so that a pass over all edges has few rows and no hub is one row."""
    hubs = saved(edges.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > LIST))
    rows, many = edges.select(F.col(key).alias("node"), F.col(other).alias("other")), hubs.count()
    if not many:
        return saved(rows.groupBy("node").agg(F.collect_list("other").alias("others")))
    cut = rows.join(maybe_broadcast(hubs, many), "node", "left").withColumn("cut", F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / LIST))).otherwise(0))
    return saved(cut.groupBy("node", "cut").agg(F.collect_list("other").alias("others")).select("node", "others"))


def _spread(out: DataFrame, labels: DataFrame) -> DataFrame:
    """For every node the smallest label that reaches it along the lists; in a round only changed labels go on."""
    fresh = labels
    while True:
        near = out.join(fresh, "node").select("label", F.explode("others").alias("node")).groupBy("node").agg(F.min("label").alias("m"))
        after = saved(labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")))
        labels, fresh = after.select("node", "label"), after.where("old <> label").select("node", "label")
        if fresh.isEmpty():
            return labels


def _trimmed(left: DataFrame) -> DataFrame:
    """Edges without nodes that no path leads through: such are in no cycle. Edges are only joined when there is such a node."""
    while True:
        ends = left.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        loose = saved(ends.groupBy("e.node").agg(F.max("e.o").alias("o"), F.max("e.i").alias("i")).where("o = 0 or i = 0").select("node"))
        n = loose.count()
        if not n:
            return left
        left = saved(_without(left, loose, n))


def _without(left: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Edges that touch none of n nodes."""
    gone = maybe_broadcast(nodes, n)
    return left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle) of every strongly connected component of two or more nodes; cycle is its smallest node.

    Colouring: every node takes the smallest node that reaches it. Within a colour, what reaches
    its root backwards is the root's component; it is set aside and the rest goes on, after nodes
    without predecessors or successors are trimmed. Edges are gathered into lists once a colouring.
    """
    left, found = saved(edges_of(edges, "src", "dst")), None
    while True:
        left = _trimmed(left)
        out = _lists(left, "src", "dst")
        if out.isEmpty():
            break
        nodes = out.select("node").distinct()  # after trimming every node has an edge that leaves it
        colour = _spread(out, nodes.select("node", F.col("node").alias("label")))
        into = _lists(left, "dst", "src")
        reached = fresh = saved(colour.where("node = label"))
        while not fresh.isEmpty():
            before = into.join(fresh, "node").select(F.explode("others").alias("node"), "label").distinct()
            fresh = saved(before.join(colour, ["node", "label"], "left_semi").join(reached, "node", "left_anti"))
            reached = saved(reached.unionByName(fresh))
        found = reached if found is None else saved(found.unionByName(reached))
        done = reached.count()
        if done == colour.count():
            break
        left = saved(_without(left, reached.select("node"), done))
        del out, into, nodes, colour, reached, fresh, before
        release(edges.sparkSession)
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("cycle")).where(F.lit(False))
    sizes = found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(sizes, "label").select("node", F.col("label").alias("cycle"))


def type_only_cycles(runtime: DataFrame, full: DataFrame) -> DataFrame:
    """(node, cycle) of cycles in full whose member set is no cycle of runtime.

    A cycle goes by its smallest node, so equal sets have equal names: only sizes and common members are counted.
    """
    all_of, own = saved(cycles(full)), saved(cycles(runtime))
    size = lambda c, name: c.groupBy("cycle").agg(F.count("*").alias(name))
    common = all_of.join(own, ["node", "cycle"], "left_semi")
    same = size(all_of, "n").join(size(own, "m"), "cycle").join(size(common, "k"), "cycle").where("n = m and n = k").select("cycle")
    return all_of.join(same, "cycle", "left_anti").select("node", "cycle")
