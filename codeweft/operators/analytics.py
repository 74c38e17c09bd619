"""Communities: pair weights, detection, numbering, labels and what crosses them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft import model
from codeweft.functions import columns as X
from codeweft.operators.graph import R, PropertyGraph, lookup
from codeweft.runtime import cut, rank_within

#: Pairs of a checkout up to which one task runs the sequential kernel; larger checkouts go through ``parallel_moves``.
KERNEL_PAIRS = 500_000


def pair_weights(g: PropertyGraph) -> DataFrame:
    """(repo_path, a, b, weight) with a < b: edges between two nodes in either direction and of any type."""
    return (
        g.edges.where("src_id <> dst_id")
        .groupBy(R, F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def louvain_kernel(pairs: pd.DataFrame, resolution: float = model.RESOLUTION, rounds: int = model.LOUVAIN_ROUNDS) -> dict[str, int]:
    """Sequential modularity optimisation of one graph: columns a, b, weight. Nodes in id order, ties stay, then lowest.

    A merged node's strength is made of the links of the level it was merged on, those inside it included; links that
    went inside on earlier levels no longer count, which is the behaviour this kernel has to reproduce.
    """
    ids = sorted(set(pairs["a"]) | set(pairs["b"]))
    at = {x: k for k, x in enumerate(ids)}
    links: list[dict[int, float]] = [{} for _ in ids]
    for a, b, w in zip(pairs["a"].map(at), pairs["b"].map(at), pairs["weight"]):
        links[a][b] = links[a].get(b, 0.0) + w
        links[b][a] = links[b].get(a, 0.0) + w
    strength = [sum(x.values()) for x in links]
    two_m = sum(strength)
    owner = list(range(len(ids)))
    if not two_m:
        return dict(zip(ids, owner))
    for _ in range(rounds):
        home = list(range(len(links)))
        total = list(strength)
        moved = False
        for _ in range(rounds):
            changed = False
            for v, own in enumerate(links):
                old = home[v]
                total[old] -= strength[v]
                inside: dict[int, float] = {}
                for u, w in own.items():
                    inside[home[u]] = inside.get(home[u], 0.0) + w
                scale = resolution * strength[v] / two_m
                best, gain = old, inside.get(old, 0.0) - scale * total[old]
                for c in sorted(inside):
                    if c != old and (x := inside[c] - scale * total[c]) > gain:
                        best, gain = c, x
                total[best] += strength[v]
                if best != old:
                    home[v], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            break
        names = {c: k for k, c in enumerate(sorted(set(home)))}
        if len(names) == len(links):
            break
        merged: list[dict[int, float]] = [{} for _ in names]
        strength = [0.0] * len(names)
        for v, own in enumerate(links):
            a = names[home[v]]
            strength[a] += sum(own.values())
            for u, w in own.items():
                b = names[home[u]]
                if a != b:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        owner = [names[home[o]] for o in owner]
        links = merged
    return dict(zip(ids, owner))


def _kernel(resolution: float):
    def run(key: tuple, pairs: pd.DataFrame) -> pd.DataFrame:
        found = louvain_kernel(pairs, resolution)
        return pd.DataFrame({R: key[0], "id": list(found), "community": np.fromiter(found.values(), np.int64, len(found)).astype(str)})

    return run


def parallel_moves(pairs: DataFrame, resolution: float = model.RESOLUTION, rounds: int = model.LOUVAIN_ROUNDS) -> DataFrame:
    """Communities of checkouts too large for one task: (repo_path, id, community).

    Every round all nodes look for the neighbouring community of greatest gain at once; half of them, chosen by a hash
    of node and round, may move, which keeps pairs from swapping for ever. Only aggregates over (node, community) and
    (community) are formed. Stops when no node moves. Its partition differs from the sequential kernel's.
    """
    both = cut(pairs.select(R, F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "weight").select(R, "e.*", "weight"))
    strength = cut(both.groupBy(R, "id").agg(F.sum("weight").alias("k")))
    two_m = cut(strength.groupBy(R).agg(F.sum("k").alias("two_m")))
    home = strength.select(R, "id", F.col("id").alias("community"))
    for no in range(rounds):
        total = lookup(strength, home, {R: R, "id": "id"}, {"c": "community"}).groupBy(R, "c").agg(F.sum("k").alias("tot"))
        inside = lookup(both, home, {R: R, "other": "id"}, {"c": "community"}).groupBy(R, "id", "c").agg(F.sum("weight").alias("k_in"))
        stay = home.select(R, "id", F.col("community").alias("c"), F.lit(0).cast("long").alias("k_in"))
        cand = inside.unionByName(stay).groupBy(R, "id", "c").agg(F.sum("k_in").alias("k_in"))
        cand = lookup(lookup(lookup(cand, strength, {R: R, "id": "id"}, {"k": "k"}), home, {R: R, "id": "id"}, {"old": "community"}), total, {R: R, "c": "c"}, {"tot": "tot"})
        cand = lookup(cand, two_m, {R: R}, {"two_m": "two_m"})
        gain = F.col("k_in") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0)) / F.col("two_m")
        best = cand.withColumn("gain", F.round(gain, 9)).groupBy(R, "id").agg(
            F.max_by("c", F.struct("gain", (F.col("c") == F.col("old")).alias("stays"), F.col("c"))).alias("best"), F.first("old").alias("old")
        )
        may = F.pmod(F.xxhash64(F.lit(no), "id"), F.lit(2)) == 0
        best = cut(best.withColumn("community", F.when(may, F.col("best")).otherwise(F.col("old"))))
        home = best.select(R, "id", "community")
        if best.where("best <> old").isEmpty():
            break
    return home


def communities(g: PropertyGraph, resolution: float = model.RESOLUTION, kernel_pairs: int = KERNEL_PAIRS) -> DataFrame:
    """(repo_path, id, community) for every node; isolated nodes are communities of their own. Numbered by ``renumber``."""
    pairs = cut(pair_weights(g))
    sizes = pairs.groupBy(R).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > kernel_pairs).select(R)
    small = lookup(pairs, large.withColumn("x", F.lit(1)), {R: R}, {"large": "x"})
    found = small.where("large is null").select(R, "a", "b", "weight").groupBy(R).applyInPandas(_kernel(resolution), f"{R} string, id string, community string")
    if not large.isEmpty():
        found = found.unionByName(parallel_moves(small.where("large is not null").select(R, "a", "b", "weight"), resolution))
    out = lookup(g.nodes.select(R, "id"), found, {R: R, "id": "id"}, {"community": "community"})
    return renumber(out.withColumn("community", F.coalesce(F.concat(F.lit("c"), F.col("community")), F.concat(F.lit("i"), F.col("id")))))


def renumber(members: DataFrame) -> DataFrame:
    """Numbers from 0 within a checkout: larger communities first, then by smallest member."""
    sizes = members.groupBy(R, "community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    numbered = rank_within(sizes, [R], [F.desc("n"), F.col("least")], "no").withColumn("no", F.col("no") - 1)
    return lookup(members, numbered, {R: R, "community": "community"}, {"no": "no"}).select(R, "id", F.col("no").cast("int").alias("community"))


def labels(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(repo_path, community, label, n_members): the commonest folder word if at least half as frequent as members.

    Else the commonest type in the plural. Word counts are per occurrence; ties go to the smaller word.
    """
    m = lookup(members, nodes, {R: R, "id": "id"}, {"file": "file", "type": "type", "properties": "properties"})
    size = m.groupBy(R, "community").agg(F.count(F.lit(1)).alias("n_members"))
    words = m.select(R, "community", F.explode(F.concat(X.path_tokens("file"), X.path_tokens(X.text_prop("properties", "name")))).alias("w")).groupBy(R, "community", "w").agg(F.count(F.lit(1)).alias("n"))
    top_word = words.groupBy(R, "community").agg(F.min_by(F.struct("w", "n"), F.struct(-F.col("n"), F.col("w"))).alias("t"))
    top_type = m.groupBy(R, "community", "type").agg(F.count(F.lit(1)).alias("n")).groupBy(R, "community").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    out = lookup(lookup(size, top_word, {R: R, "community": "community"}, {"t": "t"}), top_type, {R: R, "community": "community"}, {"type": "type"})
    word = F.concat(F.upper(F.left("t.w", F.lit(1))), F.substr("t.w", F.lit(2)))
    return out.select(R, "community", F.when(F.col("t.n") * 2 >= F.col("n_members"), word).otherwise(F.coalesce(F.concat("type", F.lit("s")), F.lit("Misc"))).alias("label"), "n_members")


def crossing_edges(g: PropertyGraph, members: DataFrame) -> DataFrame:
    """Edges between different communities with the number of edges between that pair."""
    e = lookup(lookup(g.edges, members, {R: R, "src_id": "id"}, {"src_community": "community"}), members, {R: R, "dst_id": "id"}, {"dst_community": "community"})
    e = e.where("src_community <> dst_community").select(R, "id", "type", "src_id", "dst_id", "confidence", "src_community", "dst_community", F.least("src_community", "dst_community").alias("lo"), F.greatest("src_community", "dst_community").alias("hi"))
    n = e.groupBy(R, "lo", "hi").agg(F.count(F.lit(1)).alias("pair_count"))
    return lookup(e, n, {R: R, "lo": "lo", "hi": "hi"}, {"pair_count": "pair_count"}).drop("lo", "hi")


def surprises(g: PropertyGraph, members: DataFrame, n: int = model.REPORT_SURPRISES) -> DataFrame:
    """Per checkout the first ``n`` crossing edges, rarest pair first, then by id."""
    w = Window.partitionBy(R).orderBy("pair_count", "id")
    return crossing_edges(g, members).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def questions(g: PropertyGraph, members: DataFrame, label: DataFrame, degree: DataFrame, n: int = model.REPORT_QUESTIONS) -> DataFrame:
    """Per checkout up to ``n`` questions: the first hub, then label pairs by surprise, then communities by number."""
    hub = degree.groupBy(R).agg(F.min_by(F.struct("id", "degree"), F.struct(-F.col("degree"), F.col("id"))).alias("h")).where("h.degree > 0")
    first = hub.select(R, F.lit(0).alias("part"), F.struct(F.lit(0).cast("long").alias("x"), F.lit("").alias("y")).alias("o"), F.format_string("What does `%s` do, and why is it so central (degree %d)?", "h.id", "h.degree").alias("question"))
    x = crossing_edges(g, members)
    x = lookup(lookup(x, label, {R: R, "src_community": "community"}, {"sl": "label"}), label, {R: R, "dst_community": "community"}, {"dl": "label"})
    pairs = x.groupBy(R, F.least("sl", "dl").alias("a"), F.greatest("sl", "dl").alias("b")).agg(F.min(F.struct(F.col("pair_count").alias("x"), F.col("id").alias("y"), F.col("sl").alias("s"), F.col("dl").alias("d"))).alias("o"))
    second = pairs.select(R, F.lit(1).alias("part"), F.struct("o.x", "o.y").alias("o"), F.format_string("What connects %s to %s?", "o.s", "o.d").alias("question"))
    third = label.select(R, F.lit(2).alias("part"), F.struct(F.col("community").cast("long").alias("x"), F.lit("").alias("y")).alias("o"), F.format_string("What is the responsibility of the %s subsystem?", "label").alias("question"))
    w = Window.partitionBy(R).orderBy("part", "o")
    return first.unionByName(second).unionByName(third).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(R, "rank", "question")
