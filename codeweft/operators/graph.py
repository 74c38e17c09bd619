"""The property graph as a pair of DataFrames, checkouts side by side.

Every operator works on all checkouts at once; keys start with repo_path. A node that nearly every other refers to only
makes one side of an equi-join long, which adaptive execution splits; what is grouped by node is a partial aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft import model
from codeweft.functions import columns as X
from codeweft.sources.graph_tables import distinct_edges, newest_nodes

R = "repo_path"


def semi(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join without name clashes. ``on``: column of left -> column of right."""
    r = right.select(*[F.col(v).alias(f"_s{k}") for k, v in enumerate(on.values())]).distinct()
    cond: Column | None = None
    for k, name in enumerate(on):
        e = left[name] == F.col(f"_s{k}")
        cond = e if cond is None else cond & e
    return left.join(r, cond, how)


def lookup(left: DataFrame, right: DataFrame, on: dict[str, str], take: dict[str, str], how: str = "left") -> DataFrame:
    """Adds columns of right under new names. Keys of right must be unique, else rows repeat."""
    r = right.select(*[F.col(v).alias(f"_l{k}") for k, v in enumerate(on.values())], *[F.col(v).alias(n) for n, v in take.items()])
    cond: Column | None = None
    for k, name in enumerate(on):
        e = left[name] == F.col(f"_l{k}")
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"_l{k}" for k in range(len(on))])


@dataclass
class PropertyGraph:
    nodes: DataFrame  # one row per (repo_path, id)
    edges: DataFrame  # one row per (repo_path, id), both ends there

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """From stored rows: newest version of each node, last built edge, edges without both ends left out."""
        n = newest_nodes(nodes)
        return cls(n, with_both_ends(distinct_edges(edges), n))

    def out_edges(self, keys: DataFrame) -> DataFrame:
        """Edges leaving the nodes (repo_path, id) of ``keys``."""
        return semi(self.edges, keys, {R: R, "src_id": "id"})

    def in_edges(self, keys: DataFrame) -> DataFrame:
        return semi(self.edges, keys, {R: R, "dst_id": "id"})

    def undirected(self) -> DataFrame:
        """Each edge seen from both ends: repo_path, at, other, type, confidence, outgoing, edge_id. Self-loops are left out."""
        e = self.edges.where("src_id <> dst_id")
        return e.select(
            R, F.explode(F.array(
                F.struct(F.col("src_id").alias("at"), F.col("dst_id").alias("other"), F.lit(True).alias("outgoing")),
                F.struct(F.col("dst_id").alias("at"), F.col("src_id").alias("other"), F.lit(False).alias("outgoing")),
            )).alias("e"), "type", "confidence", F.col("id").alias("edge_id"),
        ).select(R, "e.*", "type", "confidence", "edge_id")

    def induced(self, keys: DataFrame) -> DataFrame:
        """Edges with both ends among ``keys`` (repo_path, id)."""
        return semi(semi(self.edges, keys, {R: R, "src_id": "id"}), keys, {R: R, "dst_id": "id"})


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source and target are nodes of their checkout."""
    return semi(semi(edges, nodes, {R: R, "src_id": "id"}), nodes, {R: R, "dst_id": "id"})


def rejected_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an insert would refuse, with the ends that are missing."""
    keys = nodes.select(R, "id").distinct().withColumn("_there", F.lit(True))
    e = lookup(edges, keys, {R: R, "src_id": "id"}, {"src_there": "_there"})
    e = lookup(e, keys, {R: R, "dst_id": "id"}, {"dst_there": "_there"})
    return e.where("src_there is null or dst_there is null").select(R, "id", F.col("src_there").isNull().alias("src_missing"), F.col("dst_there").isNull().alias("dst_missing"))


def merge_last_wins(*graphs: DataFrame) -> DataFrame:
    """Union of node tables by (repo_path, id); a later table replaces what an earlier one holds."""
    rest = [x for x in graphs[0].columns if x not in (R, "id")]
    all_rows = None
    for no, g in enumerate(graphs):
        g = g.select(R, "id", F.struct(F.lit(no).alias("no"), *rest).alias("v"))
        all_rows = g if all_rows is None else all_rows.unionByName(g)
    return all_rows.groupBy(R, "id").agg(F.max_by("v", F.struct(F.col("v.no"), F.col("v.hash"))).alias("v")).select(R, "id", *[F.col(f"v.{x}").alias(x) for x in rest])


def id_conflicts(nodes: DataFrame) -> DataFrame:
    """Ids given more than once, with how many versions and types they have; a conflict proper has several types."""
    v = nodes.groupBy(R, "id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("hash").alias("n_hashes"), F.countDistinct("type").alias("n_types"))
    return v.where("n_rows > 1")


def degrees(g: PropertyGraph) -> DataFrame:
    """(repo_path, id, degree): edge ends at each node; a self-loop counts twice, an isolated node has 0."""
    ends = g.edges.select(R, F.explode(F.array("src_id", "dst_id")).alias("id"))
    n = ends.groupBy(R, "id").agg(F.count(F.lit(1)).alias("n"))
    return lookup(g.nodes.select(R, "id"), n, {R: R, "id": "id"}, {"degree": "n"}).withColumn("degree", F.coalesce("degree", F.lit(0)).cast("int"))


def hubs(degree: DataFrame, n: int = model.HUBS) -> DataFrame:
    """The ``n`` nodes of highest degree of each checkout, ties by id, with their rank.

    Spark keeps only ``n`` rows a group before the shuffle (WindowGroupLimit), so no group is gathered whole.
    """
    n = n if n > 0 else model.HUBS
    w = Window.partitionBy(R).orderBy(F.desc("degree"), "id")
    return degree.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def flag_hubs(degree: DataFrame, n: int = model.HUBS) -> DataFrame:
    """Every node with its degree and whether it is a hub."""
    top = hubs(degree, n).select(R, "id", F.lit(True).alias("hub"))
    return lookup(degree, top, {R: R, "id": "id"}, {"god_node": "hub"}).withColumn("god_node", F.coalesce("god_node", F.lit(False)))


def adjacency(g: PropertyGraph) -> DataFrame:
    """Per node and edge type: number of edges leaving and entering."""
    ends = g.edges.select(R, "type", F.explode(F.array(
        F.struct(F.col("src_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e")).select(R, "type", "e.*")
    return ends.groupBy(R, "id", "type").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def visible(g: PropertyGraph, types: list[str] | None = None) -> PropertyGraph:
    """The part of the graph a viewer shows: given types, or all but fields and columns; edges induced."""
    if types == ["all"]:
        return g
    n = g.nodes.where(F.col("type").isin(types) if types else ~F.col("type").isin(model.HIDDEN_TYPES))
    return PropertyGraph(n, with_both_ends(g.edges, n))
