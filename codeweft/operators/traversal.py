"""Breadth-first expansion, cheapest paths and local graphs, for many targets at once.

A level is one join of the frontier with the edges; each level is written to the shared folder, so plans stay short and
a lost executor repeats one level. Nothing is gathered by node; a crowded node only makes its side of the join long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft import model
from codeweft.functions import columns as X
from codeweft.operators.graph import R, PropertyGraph, lookup
from codeweft.runtime import cut


def levels(g: PropertyGraph, targets: DataFrame, hops: int, links: DataFrame | None = None) -> DataFrame:
    """(repo_path, target, id, hop) of all nodes within ``hops`` edges, either direction. ``targets``: repo_path, target."""
    links = links if links is not None else g.undirected()
    pairs = links.select(R, "at", "other").distinct()
    found = frontier = cut(targets.select(R, "target", F.col("target").alias("id"), F.lit(0).alias("hop")).distinct())
    for hop in range(1, hops + 1):
        step = frontier.select(F.col(R).alias("_r"), "target", F.col("id").alias("_at")).join(pairs, (F.col("_r") == F.col(R)) & (F.col("_at") == F.col("at"))).select(R, "target", F.col("other").alias("id")).distinct()
        seen = found.select(F.col(R).alias("_r"), F.col("target").alias("_t"), F.col("id").alias("_i"))
        new = step.join(seen, (F.col(R) == F.col("_r")) & (F.col("target") == F.col("_t")) & (F.col("id") == F.col("_i")), "left_anti").withColumn("hop", F.lit(hop))
        frontier = cut(new)
        found = found.unionByName(frontier)
        if hop < hops and frontier.isEmpty():
            break
    return found


def expand(g: PropertyGraph, targets: DataFrame, hops: int = model.HOPS, members: DataFrame | None = None) -> DataFrame:
    """Nodes around targets: repo_path, target, id, hop, weight, parent_id, via_edge, outgoing, confidence.

    The weight is the greatest over edges to expanded nodes (hop below ``hops``) of the edge's weight plus 1 if the
    node shares the target's community; the via edge attains it, ties to the nearer, then smaller parent, outgoing
    first, then edge id. A target nobody leads back to has weight 0 and no parent.
    """
    links = g.undirected()
    found = levels(g, targets, hops, links)
    origin = found.where(F.col("hop") < hops).select(F.col(R).alias("_r"), F.col("target").alias("_t"), F.col("id").alias("_at"), F.col("hop").alias("from_hop"))
    seen = origin.join(links, (F.col("_r") == F.col(R)) & (F.col("_at") == F.col("at")))
    w = X.edge_weight("type")
    if members is not None:
        seen = lookup(lookup(seen, members, {R: R, "_t": "id"}, {"tc": "community"}), members, {R: R, "other": "id"}, {"oc": "community"})
        w = w + F.when((F.col("tc") == F.col("oc")) & (F.col("tc") >= 0), model.BOOST).otherwise(0)
    best = seen.groupBy(R, F.col("_t").alias("t"), F.col("other").alias("i")).agg(
        F.min_by(
            F.struct(w.alias("weight"), F.col("at").alias("parent_id"), F.col("type").alias("via_edge"), F.col("outgoing"), F.col("confidence")),
            F.struct(-w, "from_hop", "at", ~F.col("outgoing"), "edge_id"),
        ).alias("v")
    )
    out = lookup(found, best, {R: R, "target": "t", "id": "i"}, {"v": "v"})
    return out.select(R, "target", "id", "hop", F.coalesce("v.weight", F.lit(0)).alias("weight"), "v.parent_id", "v.via_edge", "v.outgoing", "v.confidence")


def local_edges(g: PropertyGraph, targets: DataFrame, hops: int) -> DataFrame:
    """(repo_path, target, id, type, src_id, dst_id): edges among the nodes around each target."""
    found = levels(g, targets, hops).select(F.col(R).alias("_r"), "target", F.col("id").alias("_n"))
    e = found.join(g.edges.select(R, "id", "type", "src_id", "dst_id"), (F.col("_r") == F.col(R)) & (F.col("_n") == F.col("src_id"))).drop("_r", "_n")
    k = found.select(F.col("_r").alias("_r2"), F.col("target").alias("_t2"), F.col("_n").alias("_n2"))
    return e.join(k, (F.col(R) == F.col("_r2")) & (F.col("target") == F.col("_t2")) & (F.col("dst_id") == F.col("_n2")), "left_semi")


def distances(g: PropertyGraph, sources: DataFrame, links: DataFrame | None = None, most_rounds: int = 200) -> DataFrame:
    """(repo_path, src, id, cost, hops): cheapest way to every reachable node, an edge costing 4 minus its weight.

    Relaxation of all improved nodes at once until none improves; ``most_rounds`` is a guard that raises.
    """
    links = links if links is not None else g.undirected()
    step = cut(links.groupBy(R, "at", "other").agg(F.min(4 - X.edge_weight("type")).alias("c")))
    dist = frontier = cut(sources.select(R, "src", F.col("src").alias("id"), F.lit(0).alias("cost"), F.lit(0).alias("hops")).distinct())
    for _ in range(most_rounds):
        f = frontier.select(F.col(R).alias("_r"), "src", F.col("id").alias("_at"), "cost", "hops")
        reached = f.join(step, (F.col("_r") == F.col(R)) & (F.col("_at") == F.col("at"))).groupBy(R, "src", F.col("other").alias("id")).agg(F.min(F.struct((F.col("cost") + F.col("c")).alias("cost"), (F.col("hops") + 1).alias("hops"))).alias("v")).select(R, "src", "id", "v.*")
        known = dist.select(F.col(R).alias("_r"), F.col("src").alias("_s"), F.col("id").alias("_i"), F.struct("cost", "hops").alias("_v"))
        frontier = cut(reached.join(known, (F.col(R) == F.col("_r")) & (F.col("src") == F.col("_s")) & (F.col("id") == F.col("_i")), "left").where(F.col("_v").isNull() | (F.struct("cost", "hops") < F.col("_v"))).select(R, "src", "id", "cost", "hops"))
        if frontier.isEmpty():
            return dist
        dist = cut(dist.unionByName(frontier).groupBy(R, "src", "id").agg(F.min(F.struct("cost", "hops")).alias("v")).select(R, "src", "id", "v.*"))
    raise RuntimeError(f"distances still improve after {most_rounds} rounds")


def paths(g: PropertyGraph, pairs: DataFrame) -> DataFrame:
    """Cheapest path of every (repo_path, src, dst): rows hop_no, id, via_edge, confidence, cost; none where there is no path.

    Among equals the fewest edges, then the smallest predecessor, then the smallest edge id. src = dst gives one row.
    """
    links = cut(g.undirected())
    there = g.nodes.select(F.col(R).alias("_r"), F.col("id").alias("_i"))
    pairs = pairs.select(R, "src", "dst").distinct()
    for end in ("src", "dst"):
        pairs = pairs.join(there, (F.col(R) == F.col("_r")) & (F.col(end) == F.col("_i")), "left_semi")
    dist = distances(g, pairs, links)
    at = cut(lookup(pairs, dist, {R: R, "src": "src", "dst": "id"}, {"cost": "cost", "hops": "hops"}, "inner").withColumn("id", F.col("dst")))
    rows = None
    while True:
        back = at.where("hops > 0").select(F.col(R).alias("_r"), "src", "dst", F.col("id").alias("_id"), "cost", "hops")
        prev = back.join(links.select(R, F.col("at").alias("p"), F.col("other").alias("o"), "type", "confidence", "edge_id"), (F.col("_r") == F.col(R)) & (F.col("_id") == F.col("o")))
        prev = lookup(prev, dist, {R: R, "src": "src", "p": "id"}, {"pc": "cost", "ph": "hops"}, "inner").where((F.col("pc") + 4 - X.edge_weight("type") == F.col("cost")) & (F.col("ph") + 1 == F.col("hops")))
        best = prev.groupBy(R, "src", "dst", F.col("_id").alias("id"), "cost", "hops").agg(F.min(F.struct("p", "edge_id", "type", "confidence", "pc")).alias("v"))
        step = cut(best)
        here = lookup(at, step, {R: R, "src": "src", "dst": "dst", "id": "id"}, {"v": "v"})
        row = here.select(R, "src", "dst", F.col("hops").alias("hop_no"), "id", F.col("v.type").alias("via_edge"), "v.confidence", "cost")
        rows = row if rows is None else rows.unionByName(row)
        if step.isEmpty():
            return rows
        at = step.select(R, "src", "dst", F.col("v.p").alias("id"), F.col("v.pc").alias("cost"), (F.col("hops") - 1).alias("hops"))
