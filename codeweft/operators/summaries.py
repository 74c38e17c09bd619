"""Which nodes, files and modules need a summary, what it is made from, and whether a delivered one may be applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft import model
from codeweft.functions import columns as X
from codeweft.operators.graph import R, PropertyGraph, lookup, semi
from codeweft.sources.graph_tables import SUMMARISED_TYPES


def invalidation_targets(old: PropertyGraph, new_nodes: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(repo_path, id): new, changed and removed nodes and their neighbours in the old graph."""
    o = old.nodes.select(R, "id", F.coalesce("hash", F.lit("")).alias("h"))
    new = lookup(new_nodes.select(R, "id", F.coalesce("hash", F.lit("")).alias("h")), o, {R: R, "id": "id"}, {"oh": "h"})
    changed = new.where("oh is null or oh <> h").select(R, "id")
    in_changed = semi(old.nodes.where("file is not null"), changed_files, {R: R, "file": "file"}).select(R, "id")
    removed = semi(in_changed, new_nodes, {R: R, "id": "id"}, "left_anti")
    seeds = changed.unionByName(removed).distinct()
    near = semi(old.undirected(), seeds, {R: R, "at": "id"}).select(R, F.col("other").alias("id"))
    return seeds.unionByName(near).distinct()


def pending_nodes(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Nodes of summarised types without a current, unstale summary of level node."""
    done = summaries.where("level = 'node' and stale = 0").select(R, "node_id", "hash")
    return semi(nodes.where(F.col("type").isin(SUMMARISED_TYPES)), done, {R: R, "id": "node_id", "hash": "hash"}, "left_anti").select(R, "id", "type", "signature", "file", "line_start", "line_end", "hash")


def pending_files(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """(repo_path, id, hash, n_children): files all of whose children have a summary for their hash, stale or not.

    The file's hash is that of its children's ``id:hash`` in id order; a file whose summary carries it is done. The
    definition needs the children of one file in one string.
    """
    kids = nodes.where(F.col("type").isin(model.SPAN_TYPES) & F.col("file").isNotNull() & (F.col("file") != ""))
    s = summaries.where("level = 'node'")
    kids = lookup(kids, s, {R: R, "id": "node_id"}, {"sh": "hash"})
    ok = F.coalesce(F.col("sh") == F.col("hash"), F.lit(False))
    files = kids.groupBy(R, "file").agg(
        F.bool_and(ok).alias("complete"), F.count(F.lit(1)).cast("int").alias("n_children"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "hash"))), lambda x: F.concat(x["id"], F.lit(":"), x["hash"])), "|"), 256).alias("h"),
    ).where("complete")
    out = lookup(files, summaries.where("level = 'file'"), {R: R, "file": "node_id"}, {"fh": "hash"})
    return out.where("fh is null or fh <> h").select(R, F.col("file").alias("id"), F.col("h").alias("hash"), "n_children")


def pending_modules(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """(repo_path, id, hash, n_files): packages all of whose files have a summary; the file summary's own hash is trusted."""
    kids = nodes.where(F.col("type").isin(model.SPAN_TYPES) & F.col("file").isNotNull() & (F.col("file") != "")).select(R, X.prop("properties", "package").alias("package"), "file").where("package is not null and package <> ''").distinct()
    kids = lookup(kids, summaries.where("level = 'file'"), {R: R, "file": "node_id"}, {"fh": "hash"})
    mods = kids.groupBy(R, "package").agg(
        F.bool_and(F.col("fh").isNotNull()).alias("complete"), F.count(F.lit(1)).cast("int").alias("n_files"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "fh"))), lambda x: F.concat(x["file"], F.lit(":"), x["fh"])), "|"), 256).alias("h"),
    ).where("complete").withColumn("id", X.package_id("package"))
    out = lookup(mods, summaries.where("level = 'module'"), {R: R, "id": "node_id"}, {"mh": "hash"})
    return out.where("mh is null or mh <> h").select(R, "id", F.col("h").alias("hash"), "n_files")


def pending(level: str, nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    ways = {"node": pending_nodes, "file": pending_files, "module": pending_modules}
    if level not in ways:
        raise ValueError(f"unknown level {level!r}")
    return ways[level](nodes, summaries)


def apply_summaries(level: str, entries: DataFrame, nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Entries (repo_path, id, hash, summary) with ``outcome``: applied, unknown id, or hash mismatch.

    At file and module level only what is pending is known, so a current summary handed in again is an unknown id.
    """
    known = nodes.select(R, "id", "hash") if level == "node" else pending(level, nodes, summaries).select(R, "id", "hash")
    e = lookup(entries, known.withColumn("there", F.lit(True)), {R: R, "id": "id"}, {"want": "hash", "there": "there"})
    outcome = F.when(F.col("there").isNull(), "unknown id").when(F.col("want").eqNullSafe(F.col("hash")), "applied").otherwise("hash mismatch (code changed since export)")
    return e.withColumn("outcome", outcome).drop("want", "there")


def source_text(g: PropertyGraph) -> DataFrame:
    """(repo_path, id, source): what a summary of a node without an own stretch of source is made from.

    Tables list their columns and the tables and columns that refer to them, endpoints their handler, dependencies
    their version; enums, decorators, variables and aliases their signature.
    """
    n = g.nodes
    e = g.edges.select(R, "type", "src_id", "dst_id")
    cols = lookup(lookup(e.where("type = 'has_field'"), n.where("type = 'Table'"), {R: R, "src_id": "id"}, {"t": "id"}, "inner"), n, {R: R, "dst_id": "id"}, {"ct": "type", "cp": "properties"}, "inner")
    cols = cols.select(R, F.col("src_id").alias("id"), F.concat_ws(" ", F.concat(F.lit("- "), X.base_name(F.replace(F.col("dst_id"), F.lit("."), F.lit("/")))), F.nullif(X.text_prop("cp", "sql_type"), F.lit(""))).alias("line"))
    col_text = cols.groupBy(R, "id").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("cols"))
    refs = e.where("type = 'references_fk'").groupBy(R, F.col("dst_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("src_id")), ", ").alias("refs"))
    tables = lookup(lookup(n.where("type = 'Table'").select(R, "id"), col_text, {R: R, "id": "id"}, {"cols": "cols"}), refs, {R: R, "id": "id"}, {"refs": "refs"})
    tables = tables.select(R, "id", F.concat(F.lit("Table "), F.substr("id", F.lit(7)), F.coalesce(F.concat(F.lit("\nColumns:\n"), "cols"), F.lit("")), F.coalesce(F.concat(F.lit("\nReferenced by: "), "refs"), F.lit(""))).alias("source"))
    handler = e.where("type in ('exposes_endpoint', 'routed')").select(R, F.explode(F.array(F.struct(F.col("dst_id").alias("id"), F.col("src_id").alias("h")), F.struct(F.col("src_id").alias("id"), F.col("dst_id").alias("h")))).alias("x")).groupBy(R, F.col("x.id").alias("id")).agg(F.min("x.h").alias("h"))
    ends = lookup(n.where("type = 'Endpoint'").select(R, "id"), handler, {R: R, "id": "id"}, {"h": "h"}).select(R, "id", F.concat(F.lit("Endpoint "), F.substr("id", F.lit(10)), F.coalesce(F.concat(F.lit("\nHandler: "), "h"), F.lit(""))).alias("source"))
    deps = n.where("type = 'ExternalDependency'").select(R, "id", F.concat(F.lit("External dependency "), F.substr("id", F.lit(5)), F.coalesce(F.concat(F.lit("@"), F.nullif(X.text_prop("properties", "version"), F.lit(""))), F.lit(""))).alias("source"))
    rest = n.where(F.col("type").isin("Enum", "Decorator", "Variable", "TypeAlias")).select(R, "id", F.concat("type", F.lit(" "), F.coalesce(F.nullif("signature", F.lit("")), F.col("id"))).alias("source"))
    return tables.unionByName(ends).unionByName(deps).unionByName(rest)
