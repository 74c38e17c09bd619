"""Lexical search and resolution of what a user names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import columns as X
from codeweft.operators.graph import R, lookup
from codeweft.sources.graph_tables import SUMMARISED_TYPES


def terms(query: str) -> list[str]:
    return re.findall(r"[a-z0-9_]+", query.lower())


def score(nodes: DataFrame, summaries: DataFrame, query: str) -> DataFrame:
    """(repo_path, id, score): how often the query's words occur in summary, signature and name; above 0 only.

    A word the query repeats counts as often. ``summaries`` holds one row per node (level node).
    """
    q = terms(query)
    s = lookup(nodes.where(F.col("type").isin(SUMMARISED_TYPES)), summaries.where("level = 'node'"), {R: R, "id": "node_id"}, {"summary": "summary"})
    text = F.concat_ws(" ", F.nullif("summary", F.lit("")), F.coalesce("signature", F.lit("")), F.nullif(X.text_prop("properties", "name"), F.lit("")))
    words = s.select(R, "id", X.tokens(text).alias("w"))
    total = F.lit(0)
    for t in sorted(set(q)):
        total = total + q.count(t) * F.size(F.filter("w", F.lit(t).eqNullSafe))
    return words.select(R, "id", total.cast("int").alias("score")).where("score > 0")


def search(nodes: DataFrame, summaries: DataFrame, query: str, top: int = 10) -> DataFrame:
    """The ``top`` best nodes of every checkout by score, ties by id. No words or no places: nothing."""
    if not terms(query) or top <= 0:
        return score(nodes, summaries, "a").limit(0).withColumn("rank", F.lit(0))
    w = Window.partitionBy(R).orderBy(F.desc("score"), "id")
    return score(nodes, summaries, query).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def resolve(nodes: DataFrame, summaries: DataFrame, target: str) -> DataFrame:
    """(repo_path, id, how): what ``target`` names in each checkout; checkouts without a match are left out.

    Exact id, else exact name (least id), else a file by path or base name (the package of its nodes if there is one,
    else the least id), else the best search hit.
    """
    def pick(df: DataFrame, how: str, order: int) -> DataFrame:
        return df.groupBy(R).agg(F.min("id").alias("id")).select(R, "id", F.lit(how).alias("how"), F.lit(order).alias("o"))

    exact = pick(nodes.where(F.col("id") == target), "id", 0)
    named = pick(nodes.where(X.prop("properties", "name") == target), "name", 1)
    in_file = nodes.where((F.col("file") == target) | (X.base_name("file") == target))
    packages = in_file.select(R, X.package_id(F.nullif(X.prop("properties", "package"), F.lit(""))).alias("id")).where("id is not null").distinct()
    packages = packages.join(nodes.select(F.col(R).alias("_r"), F.col("id").alias("_i")), (F.col(R) == F.col("_r")) & (F.col("id") == F.col("_i")), "left_semi")
    found = exact.unionByName(named).unionByName(pick(packages, "package", 2)).unionByName(pick(in_file, "file", 3))
    hit = search(nodes, summaries, target, 1).select(R, "id", F.lit("search").alias("how"), F.lit(4).alias("o"))
    return found.unionByName(hit).groupBy(R).agg(F.min_by(F.struct("id", "how"), "o").alias("v")).select(R, "v.id", "v.how")
