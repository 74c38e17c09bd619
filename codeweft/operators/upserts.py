"""Idempotent writes as DataFrame rewrites: what is written, what stays, what goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.graph import R, lookup, semi


def canonical_json(bag: Column) -> Column:
    """Text of a property bag with sorted keys, so that equal bags compare equal; null for a null bag."""
    return F.to_json(F.try_parse_json(bag))


def _two_sides(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows of each key side by side as structs ``o`` and ``n``: one aggregate instead of a full outer join."""
    cols = [x for x in old.columns if x not in keys]
    a = old.select(*keys, F.struct(*cols).alias("o"), F.lit(None).cast(old.select(F.struct(*cols).alias("s")).schema["s"].dataType).alias("n"))
    b = new.select(*keys, F.lit(None).cast(a.schema["o"].dataType).alias("o"), F.struct(*[F.col(x).cast(old.schema[x].dataType).alias(x) for x in cols]).alias("n"))
    return a.unionByName(b).groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n"))


def gate_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_path, id, state): what an upsert does: ``written`` (new or other hash), ``unchanged``, ``kept`` (only stored)."""
    state = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull() | ~F.col("o.hash").eqNullSafe(F.col("n.hash")), "written").otherwise("unchanged")
    return _two_sides(old.select(R, "id", "hash"), new.select(R, "id", "hash"), [R, "id"]).select(R, "id", state.alias("state"))


def upsert_nodes(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Stored nodes after writing ``new``. A row whose hash is stored stays as it is, updated_at and lines included."""
    cols = [x for x in old.columns if x not in (R, "id")]
    pick = F.when(F.col("n").isNotNull() & (F.col("o").isNull() | ~F.col("o.hash").eqNullSafe(F.col("n.hash"))), F.col("n").withField("updated_at", F.lit(now).cast("long"))).otherwise(F.col("o"))
    return _two_sides(old, new, [R, "id"]).select(R, "id", pick.alias("v")).select(R, "id", *[F.col(f"v.{x}").alias(x) for x in cols])


def gate_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_path, id, state) for edges: written where properties or confidence differ; no confidence counts as EXTRACTED."""
    def side(e: DataFrame) -> DataFrame:
        return e.select(R, "id", F.coalesce(F.nullif("confidence", F.lit("")), F.lit("EXTRACTED")).alias("confidence"), F.coalesce(canonical_json(F.col("properties")), F.lit("null")).alias("properties"))

    state = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull() | (F.col("o") != F.col("n")), "written").otherwise("unchanged")
    return _two_sides(side(old), side(new), [R, "id"]).select(R, "id", state.alias("state"))


def refresh_properties(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored nodes with the properties of ``fresh`` where it has the id; nothing else changes, no row is added."""
    f = fresh.select(R, "id", "properties", F.lit(True).alias("there"))
    out = lookup(stored, f, {R: R, "id": "id"}, {"_p": "properties", "_there": "there"})
    return out.withColumn("properties", F.when(F.col("_there"), F.col("_p")).otherwise(F.col("properties"))).drop("_p", "_there")


def delete_files(nodes: DataFrame, edges: DataFrame, summaries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the nodes of ``files`` (repo_path, file), their edges at either end, and summaries kept under their ids."""
    gone = semi(nodes.where("file is not null"), files, {R: R, "file": "file"}).select(R, "id")
    left = semi(edges, gone, {R: R, "src_id": "id"}, "left_anti")
    return semi(nodes, gone, {R: R, "id": "id"}, "left_anti"), semi(left, gone, {R: R, "dst_id": "id"}, "left_anti"), semi(summaries, gone, {R: R, "node_id": "id"}, "left_anti")


def upsert_summaries(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Summaries with ``rows`` in place of what was kept under their (repo_path, node_id, level); none of them stale."""
    keep = semi(stored, rows, {R: R, "node_id": "node_id", "level": "level"}, "left_anti")
    return keep.unionByName(rows.withColumn("stale", F.lit(0)).select(*stored.columns))


def mark_stale(summaries: DataFrame, ids: DataFrame, level: str = "node") -> DataFrame:
    """Summaries of one level with ``stale`` set for the ids (repo_path, id); ids without a summary change nothing."""
    t = ids.select(R, "id").distinct().withColumn("hit", F.lit(True))
    out = lookup(summaries, t, {R: R, "node_id": "id"}, {"_hit": "hit"})
    return out.withColumn("stale", F.when(F.col("_hit") & (F.col("level") == level), 1).otherwise(F.col("stale"))).drop("_hit")


def set_last_commit(meta: DataFrame, rows: DataFrame) -> DataFrame:
    """build_meta with ``rows`` (repo_path, last_commit, last_build_at) in place of the rows of their checkouts."""
    return semi(meta, rows, {R: R}, "left_anti").unionByName(rows.select(*meta.columns))


