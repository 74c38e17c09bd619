"""References to records that are not there, and what hangs on them.

Level 0 are the direct orphans: an end of an edge that names no node standing at the end of the month in which the edge
was written. From there a cascade follows the foreign keys down: a node owned (has_method, has_field) by an orphaned
reference is a child of a missing record, references to it inherit its state, and so on until a round adds nothing.
Every round is a semi-join of the references with the round before, which is written to the shared folder.

``orphan_cascade`` looks at every month by itself: a reference inherits only from an owning edge written in its own month.
``lasting_cascade`` carries the state on: a child is orphaned from the owning edge's month until the missing record stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.graph import lookup
from codeweft.runtime import cut, month_no, utc_month
from codeweft.sources.graph_tables import with_removal

#: Edge types whose source owns their target. Fixed values.
OWNING = ["has_method", "has_field"]

#: The month until which a record is missing that never stands again.
NEVER = 2_000_000_000


def standing_months(nodes: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(repo_path, id, spans): months [from, to) at whose end some version stands; to is null while it still does.

    Versions fold by their last month before they are collected, so a list has at most one entry for each month.
    """
    rows = nodes.where(F.col("repo_path").isNotNull() & F.col("id").isNotNull() & F.col("updated_at").isNotNull()).select("repo_path", "id", "file", "updated_at")
    spans = with_removal(rows, commit_files).select(
        "repo_path", "id", month_no(F.col("updated_at")).alias("from"), month_no(F.floor(F.col("removed_at") / 1_000_000)).alias("to")
    )
    return (
        spans.where(F.col("to").isNull() | (F.col("to") > F.col("from")))
        .groupBy("repo_path", "id", "to").agg(F.min("from").alias("from"))
        .groupBy("repo_path", "id").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    )


def references(edges: DataFrame) -> DataFrame:
    """Each reference once: (repo_path, edge_id, type, field, ref, other, period, month). Null keys or times are left out."""
    return (
        edges.where(F.col("repo_path").isNotNull() & F.col("id").isNotNull() & F.col("built_at").isNotNull())
        .select("repo_path", F.col("id").alias("edge_id"), "type", "src_id", "dst_id", utc_month(F.col("built_at")).alias("period"), month_no(F.floor(F.unix_micros("built_at") / 1_000_000)).alias("month"))
        .distinct()
        .select(
            "repo_path", "edge_id", "type", "period", "month",
            F.explode(F.array(
                F.struct(F.lit("src_id").alias("field"), F.col("src_id").alias("ref"), F.col("dst_id").alias("other")),
                F.struct(F.lit("dst_id").alias("field"), F.col("dst_id").alias("ref"), F.col("src_id").alias("other")),
            )).alias("e"),
        )
        .select("repo_path", "edge_id", "type", "period", "month", "e.*")
        .where(F.col("ref").isNotNull())
    )


def direct_orphans(refs: DataFrame, standing: DataFrame) -> DataFrame:
    s = standing.select(F.col("repo_path").alias("_r"), F.col("id").alias("_i"), "spans")
    there = F.exists("spans", lambda x: (x["from"] <= F.col("month")) & (x["to"].isNull() | (x["to"] > F.col("month"))))
    # A crowded (checkout, id) only makes the left side large, which adaptive execution splits.
    return refs.join(s, (F.col("repo_path") == F.col("_r")) & (F.col("ref") == F.col("_i")), "left").where(~F.coalesce(there, F.lit(False))).drop("_r", "_i", "spans")


OUT = ["repo_path", "edge_id", "field", "period", "kind", "level"]


def orphan_cascade(edges: DataFrame, nodes: DataFrame, commit_files: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(repo_path, edge_id, field, period, kind, level): kind ``direct`` at level 0, ``inherited`` from level 1 on.

    Owning edge and inheriting reference are of the same month. A reference is reported once, with its lowest level. ``max_rounds`` is only a guard: reaching it raises, it never
    shortens the result. Empty edges give no rows; with empty nodes every reference is direct.
    """
    keys = ["repo_path", "edge_id", "field", "period"]
    refs = references(edges)
    found = cut(direct_orphans(refs, standing_months(nodes, commit_files)).withColumn("level", F.lit(0)))
    frontier = found
    for level in range(1, max_rounds + 1):
        owned = frontier.where((F.col("field") == "src_id") & F.col("type").isin(OWNING)).select(F.col("repo_path").alias("_r"), F.col("other").alias("_i"), F.col("period").alias("_p")).distinct()
        hit = refs.join(owned, (F.col("repo_path") == F.col("_r")) & (F.col("ref") == F.col("_i")) & (F.col("period") == F.col("_p")), "left_semi")
        known = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        new = hit.join(known, [F.col(k) == F.col(f"_k_{k}") for k in keys], "left_anti").withColumn("level", F.lit(level))
        frontier = cut(new)
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return found.withColumn("kind", F.when(F.col("level") == 0, "direct").otherwise("inherited")).select(*OUT)


def lasting_cascade(edges: DataFrame, nodes: DataFrame, commit_files: DataFrame, max_rounds: int = 50) -> DataFrame:
    """As ``orphan_cascade``, but an orphaned state lasts over months.

    The child of an owning edge is orphaned from the edge's month on, up to the month at whose end the missing record at
    the top stands again; references to it written in between inherit. What is owned in between is orphaned from its own
    owning edge's month up to the same end. A reference reached again is followed again only if its state then lasts
    longer, so rounds end. Holds at least what ``orphan_cascade`` finds.
    """
    keys = ["repo_path", "edge_id", "type", "field", "ref", "other", "month"]
    refs = references(edges)
    standing = cut(standing_months(nodes, commit_files))
    again = F.array_min(F.transform(F.filter("spans", lambda x: x["from"] > F.col("month")), lambda x: x["from"]))
    direct = lookup(direct_orphans(refs, standing), standing, {"repo_path": "repo_path", "ref": "id"}, {"spans": "spans"})
    found = cut(direct.withColumn("until", F.coalesce(again, F.lit(NEVER))).withColumn("level", F.lit(0)).drop("spans"))
    frontier = found
    for level in range(1, max_rounds + 1):
        owned = (
            frontier.where((F.col("field") == "src_id") & F.col("type").isin(OWNING))
            .groupBy(F.col("repo_path").alias("_r"), F.col("other").alias("_i"), "month").agg(F.max("until").alias("until"))
            .groupBy("_r", "_i").agg(F.collect_list(F.struct("month", "until")).alias("states"))  # at most one for each month
        )
        lasts = F.array_max(F.transform(F.filter("states", lambda x: (x["month"] <= F.col("month")) & (x["until"] > F.col("month"))), lambda x: x["until"]))
        hit = refs.join(owned, (F.col("repo_path") == F.col("_r")) & (F.col("ref") == F.col("_i"))).withColumn("until", lasts).where("until is not null").drop("_r", "_i", "states")
        known = found.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("until").alias("_until"))
        new = hit.join(known, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").where("_until is null or until > _until").select(*refs.columns, "until")
        frontier = cut(new.withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    out = found.groupBy("repo_path", "edge_id", "field", "period").agg(F.min("level").alias("level"))
    return out.withColumn("kind", F.when(F.col("level") == 0, "direct").otherwise("inherited")).select(*OUT)
