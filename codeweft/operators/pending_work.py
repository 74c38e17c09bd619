"""What the next build has to process, from the interval ledger of what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators import intervals
from codeweft.runtime import cut
from codeweft.sources.graph_tables import SUMMARISED_TYPES, newest_build, newest_nodes, with_removal

STREAM = ["kind", "repo_path", "part"]


def file_records(commit_files: DataFrame) -> DataFrame:
    """One record per (checkout, commit, file); the stream is the checkout, the sequence number the commit's place."""
    return commit_files.where(F.col("file").isNotNull() & F.col("repo_path").isNotNull()).select(
        F.lit("file").alias("kind"), "repo_path", F.lit("").alias("part"), F.col("commit_no").cast("long").alias("seq"), F.col("file").alias("record_key")
    ).distinct()


def file_ledger(build_meta: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Commits up to last_commit are done. A shortened hash stands for the commit it begins; an unknown one for none."""
    built = newest_build(build_meta).where(F.col("last_commit").isNotNull())
    commits = commit_files.where(F.col("commit_hash").isNotNull()).groupBy("repo_path", "commit_hash").agg(F.max("commit_no").cast("long").alias("no"))
    return (
        commits.join(built.withColumnRenamed("repo_path", "_r"), (F.col("repo_path") == F.col("_r")) & F.startswith("commit_hash", "last_commit"))
        .groupBy("repo_path")
        .agg(F.max("no").alias("hi"))
        .select(F.lit("file").alias("kind"), "repo_path", F.lit("").alias("part"), F.lit(-(2**31)).cast("long").alias("lo"), "hi")
    )


def node_records(nodes: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Newest standing version of each summarised node; its stream is the node, the sequence number updated_at."""
    slim = nodes.select("repo_path", "id", "type", "file", "line_start", "hash", "properties", "updated_at").withColumn("properties", F.lit(None).cast("string"))
    newest = newest_nodes(slim).where(F.col("type").isin(SUMMARISED_TYPES))
    return with_removal(newest, commit_files).where(F.col("removed_at").isNull()).select(
        F.lit("node").alias("kind"), "repo_path", F.col("id").alias("part"), F.col("updated_at").cast("long").alias("seq"), F.col("id").alias("record_key"), "hash"
    )


def node_ledger(records: DataFrame, summaries: DataFrame) -> DataFrame:
    """A version is done when a summary of level node carries its hash and is not stale."""
    fresh = summaries.where((F.col("level") == "node") & (F.col("stale") == 0)).select(F.col("repo_path").alias("_r"), F.col("node_id").alias("_n"), F.col("hash").alias("_h"))
    done = records.join(fresh, (F.col("repo_path") == F.col("_r")) & (F.col("part") == F.col("_n")) & (F.col("hash") == F.col("_h")), "left_semi")
    return done.select(*STREAM, F.col("seq").alias("lo"), F.col("seq").alias("hi"))


def pending_work(nodes: DataFrame, summaries: DataFrame, build_meta: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(kind, repo_path, record_key): files and nodes that no finished run covers, each once.

    A checkout without a usable last_commit has all its files pending; null hashes are never done; copies, null files
    and empty tables change nothing.
    """
    nr = cut(node_records(nodes, commit_files))  # read several times below
    records = cut(file_records(commit_files)).unionByName(nr.drop("hash"))
    ledger = file_ledger(build_meta, commit_files).unionByName(node_ledger(nr, summaries))
    return intervals.pending(records, ledger, STREAM, "seq").select("kind", "repo_path", "record_key").distinct()
