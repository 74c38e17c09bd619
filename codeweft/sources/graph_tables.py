"""The stored graph tables as DataFrames with one row per entity.

Ids are unique only inside a checkout, so every key starts with ``repo_path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["repo_path", "id"]

#: Node types that get summaries. Fixed values.
SUMMARISED_TYPES = ["Struct", "Interface", "Function", "Table", "Endpoint", "ExternalDependency", "Enum", "Decorator", "Variable", "TypeAlias"]


def newest_nodes(nodes: DataFrame) -> DataFrame:
    """One row per (repo_path, id): the version with the greatest updated_at, on a tie the greatest hash.

    ``max_by`` over a struct is a partial aggregate: copies and old versions meet their successor before the shuffle.
    """
    rest = [c for c in nodes.columns if c not in KEY]
    return (
        nodes.groupBy(*KEY)
        .agg(F.max_by(F.struct(*rest), F.struct("updated_at", "hash", "line_start", "properties")).alias("v"))
        .select(*KEY, *[F.col(f"v.{c}").alias(c) for c in rest])
    )


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per (repo_path, id): the one built last, on a tie the greatest confidence and properties."""
    rest = [c for c in edges.columns if c not in KEY]
    return (
        edges.groupBy(*KEY)
        .agg(F.max_by(F.struct(*rest), F.struct("built_at", "confidence", "properties")).alias("v"))
        .select(*KEY, *[F.col(f"v.{c}").alias(c) for c in rest])
    )


def removal_times(commit_files: DataFrame) -> DataFrame:
    """(repo_path, file, removals): sorted distinct unix microseconds at which a commit removed the file."""
    return (
        commit_files.where((F.col("change") == "D") & F.col("file").isNotNull() & F.col("committed_at").isNotNull())
        .groupBy("repo_path", "file")
        .agg(F.array_sort(F.collect_set(F.unix_micros("committed_at"))).alias("removals"))
    )


def with_removal(nodes: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Adds ``removed_at`` (unix microseconds, null while the row stands): first removal of its file after updated_at."""
    r = removal_times(commit_files).select(F.col("repo_path").alias("_r"), F.col("file").alias("_f"), "removals")
    later = F.filter("removals", lambda t: t > F.col("updated_at") * 1_000_000)
    return (
        nodes.join(r, (F.col("repo_path") == F.col("_r")) & (F.col("file") == F.col("_f")), "left")
        .withColumn("removed_at", F.array_min(later))
        .drop("_r", "_f", "removals")
    )


def newest_build(build_meta: DataFrame) -> DataFrame:
    """(repo_path, last_commit): of each checkout the row with the greatest last_build_at; empty commits as null."""
    return build_meta.groupBy("repo_path").agg(
        F.max_by(F.struct(F.nullif(F.trim("last_commit"), F.lit("")).alias("c")), F.struct(F.coalesce("last_build_at", F.lit(-1)), F.coalesce("last_commit", F.lit("")))).getField("c").alias("last_commit")
    )


def one_summary(summaries: DataFrame) -> DataFrame:
    """One row per (repo_path, node_id, level): one that is not stale before one that is, then the greatest hash, summary, model."""
    rest = ["hash", "summary", "model", "stale"]
    return (
        summaries.groupBy("repo_path", "node_id", "level")
        .agg(F.max_by(F.struct(*rest), F.struct(-F.col("stale"), "hash", "summary", "model")).alias("v"))
        .select("repo_path", "node_id", "level", *[F.col(f"v.{x}").alias(x) for x in rest])
    )
