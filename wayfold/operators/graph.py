"""Edges (src_type, src_id, rel, dst_type, dst_id, weight) and their traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.knowledge import top_per
from wayfold.tables import dropped, stored

EDGE = ["src_type", "src_id", "rel", "dst_type", "dst_id", "weight"]


def edge(df: DataFrame, src_type: str, src: str, rel: str, dst_type: str, dst: str, weight=None) -> DataFrame:
    """df as edges; ids become strings."""
    return df.select(F.lit(src_type).alias("src_type"), F.col(src).cast("string").alias("src_id"), F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"), F.col(dst).cast("string").alias("dst_id"), (F.lit(1.0) if weight is None else weight).cast("double").alias("weight"))


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 1, cap: int = 50) -> DataFrame:
    """From seeds (q, node, score) along edges (src, dst), one unrolled join a hop; each hop keeps `cap`
    destinations a query, by score then id. Columns q, node, hop, score (the best), paths."""
    out, front = None, seeds
    for hop in range(1, hops + 1):
        step = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").groupBy("q", F.col("dst").alias("node")).agg(F.max("score").alias("score"), F.count(F.lit(1)).cast("bigint").alias("paths"))
        front = top_per(step, "q", [F.col("score").desc(), F.col("node").asc()], cap).drop("rank")
        part = front.withColumn("hop", F.lit(hop).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out


def closure(parents: DataFrame) -> DataFrame:
    """(node, ancestor, hops): all that is reached from each node of (node, parent) by any number of steps up, with the
    least number. Any graph will do: several parents, cycles (nothing is its own ancestor), any depth. Every round only
    the pairs found in the round before take a step, and pairs already known are left out, until there are none."""
    up = stored(parents.where("node is not null and parent is not null and node != parent").select("node", "parent").distinct())
    step = up.select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    found = [stored(up.select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("hops")))]
    known = found[0]
    while not found[-1].isEmpty():
        ahead = found[-1].join(step, "ancestor").select("node", F.col("next").alias("ancestor")).where("node != ancestor").distinct()
        new = ahead.join(known, ["node", "ancestor"], "left_anti")
        found.append(stored(new.withColumn("hops", F.lit(len(found) + 1).cast("long"))))
        known = known.unionByName(found[-1])
    out = stored(known)
    dropped(up, *found)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes of the edges (src, dst), taken both ways, with the least node of their component.

    Every node hangs on a smaller one by turns: its larger neighbours hang on its least neighbour (so stars grow), then
    its smaller neighbours and itself do (so chains fold), until nothing moves. Rounds grow with the logarithm of the
    longest path, and no component is ever gathered in one place."""
    own = edges.where("src is not null and dst is not null and src != dst")
    e = stored(own.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        after = stored(small.where("u != v").distinct())
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(e, large)
        if now == state:
            break
        e, state = after, now
    # nothing hangs on anything but roots now
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, most: int = 200) -> DataFrame:
    """(node, rank): the stationary share of a walk that follows a random edge (src, dst; repeated ones count once, an
    edge of a node to itself counts) with probability `damping` and else, as from nodes without edges, goes to a random
    node. Ranks are shares times the number of nodes, so that their mean is 1. Rounds end when the shares together move
    by less than `tolerance`, or after `most`.

    Nodes that no edge leads to have one rank in common, so their edges are summed up once by the nodes they lead to, and
    only the others go through the rounds."""
    e = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    led = stored(e.select(F.col("dst").alias("node")).distinct())
    out = e.groupBy("src").agg((1.0 / F.count(F.lit(1))).alias("share")).join(led.withColumn("led", F.lit(True)), F.col("src") == F.col("node"), "left")
    out = stored(out.select("src", "share", F.coalesce("led", F.lit(False)).alias("led")))
    links = stored(e.join(out.where("led").drop("led"), "src").select("src", "dst", "share"))
    once = e.join(out.where("not led"), "src").groupBy(F.col("dst").alias("to")).agg(F.sum("share").alias("once"))
    leaving = out.where("led").select(F.col("src").alias("leaves"))
    # ends: no edge leaves it
    ranks = stored(led.join(once, F.col("node") == F.col("to"), "left").join(leaving, F.col("node") == F.col("leaves"), "left").select("node", F.col("leaves").isNull().alias("ends"), F.coalesce("once", F.lit(0.0)).alias("once"), F.lit(1.0).alias("rank")))
    count, lost = ranks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("ends").cast("double")), F.lit(0.0))).first()
    starts, start = out.where("not led").count(), 1.0
    n = max(count + starts, 1)
    dropped(e, led)
    for _ in range(most):
        came = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("share") * F.col("rank")).alias("came"))
        walk = F.coalesce("came", F.lit(0.0)) + F.col("once") * start + F.lit(lost / n)
        new = stored(ranks.join(came, F.col("node") == F.col("to"), "left").select("node", "ends", "once", (F.lit(1 - damping) + damping * walk).alias("rank"), F.abs(F.lit(1 - damping) + damping * walk - F.col("rank")).alias("moved")))
        was, start = start, 1 - damping + damping * lost / n
        moved, lost = new.agg(F.coalesce(F.sum("moved"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("ends"), F.col("rank"))), F.lit(0.0))).first()
        dropped(ranks)
        ranks = new
        if (moved + starts * abs(start - was)) / n < tolerance:
            break
    dropped(links)
    return ranks.select("node", "rank").unionByName(out.where("not led").select(F.col("src").alias("node"), F.lit(start).alias("rank")))
