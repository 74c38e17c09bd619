"""p2, p3, p5 and p6: record keeping over graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.dense_counts import dense_sums
from codeweft.operators.orphans import lasting_cascade, orphan_cascade
from codeweft.operators.pending_work import pending_work
from codeweft.operators.snapshot_diff import snapshot_changes
from codeweft.runtime import SEP, table

#: Share of all edge rows from which an id counts as crowded.
CROWDED = 0.02


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pending_work(*[table(spark, d, t) for t in ("nodes", "summaries", "build_meta", "commit_files")])


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("repo_path", "kind").agg(F.count(F.lit(1)).alias("n_pending"))


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge row as (side, type, node_id, other)."""
    both = F.explode(F.array(
        F.struct(F.lit("src").alias("side"), F.col("src_id").alias("node_id"), F.col("dst_id").alias("other")),
        F.struct(F.lit("dst").alias("side"), F.col("dst_id").alias("node_id"), F.col("src_id").alias("other")),
    ))
    return edges.select("type", both.alias("e")).select("e.side", "type", "e.node_id", "e.other").where(F.col("node_id").isNotNull() & F.col("type").isNotNull())


def end_key():
    return F.concat_ws(SEP, "side", "type", "node_id")


def split_key(sums: DataFrame, total: str) -> DataFrame:
    part = F.split("key", SEP, 3)
    return sums.select(part[0].alias("side"), part[1].alias("type"), part[2].alias("node_id"), F.col("total").alias(total))


def p3_degree(spark: SparkSession, d: str) -> DataFrame:
    return split_key(dense_sums(ends(table(spark, d, "edges").select("type", "src_id", "dst_id")), end_key()), "degree")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Different neighbours of every id per side and type; copies meet before the shuffle."""
    pairs = ends(table(spark, d, "edges").select("type", "src_id", "dst_id").distinct()).where(F.col("other").isNotNull())
    return split_key(dense_sums(pairs, end_key()), "neighbours")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "edges").agg(F.count(F.lit(1)).alias("n"))
    return p3_degree(spark, d).where(F.col("degree") >= CROWDED * rows.scalar()).select("side", "type", "node_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "node_snapshots"), table(spark, d, "edge_snapshots"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("tab", "snapshot_no", "change").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("repo_path").alias("n_checkouts"))


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    return orphan_cascade(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "commit_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d).where(F.col("kind") == "direct").select("repo_path", "edge_id", "field", "period")


def _report(cascade: DataFrame) -> DataFrame:
    return cascade.groupBy("field", "period", "kind", "level").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("repo_path").alias("n_checkouts"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Month by month, as its SQL has it; ``p6_lasting`` carries the state over months."""
    return _report(_cascade(spark, d))


def p6_lasting(spark: SparkSession, d: str) -> DataFrame:
    return _report(lasting_cascade(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "commit_files")))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_degree, p3_neighbours, p5_found, p5_report, p6_found, p6_report, p6_lasting)}

_P2 = """
WITH meta AS (
  SELECT repo_path, nullif(trim(arg_max(coalesce(last_commit, ''), coalesce(last_build_at, -1))), '') AS last_commit FROM build_meta GROUP BY 1
), done AS (
  SELECT c.repo_path, max(c.commit_no) AS hi FROM commit_files c JOIN meta m ON c.repo_path = m.repo_path AND starts_with(c.commit_hash, m.last_commit) GROUP BY 1
), newest AS (
  SELECT repo_path, id, arg_max(type, updated_at) AS type, arg_max(coalesce(file, ''), updated_at) AS file, arg_max(hash, updated_at) AS hash, max(updated_at) AS updated_at FROM nodes GROUP BY 1, 2
), found AS (
  SELECT DISTINCT 'file' AS kind, c.repo_path, c.file AS record_key FROM commit_files c LEFT JOIN done d ON c.repo_path = d.repo_path
  WHERE c.file IS NOT NULL AND (d.hi IS NULL OR c.commit_no > d.hi)
  UNION ALL
  SELECT 'node', n.repo_path, n.id FROM newest n
  WHERE n.type IN ('Struct', 'Interface', 'Function', 'Table', 'Endpoint', 'ExternalDependency', 'Enum', 'Decorator', 'Variable', 'TypeAlias')
    AND NOT EXISTS (SELECT 1 FROM commit_files c WHERE c.repo_path = n.repo_path AND c.file = n.file AND c.change = 'D' AND epoch_us(c.committed_at) > n.updated_at * 1000000)
    AND NOT EXISTS (SELECT 1 FROM summaries s WHERE s.repo_path = n.repo_path AND s.node_id = n.id AND s.level = 'node' AND s.hash = n.hash AND s.stale = 0)
)"""

_P3 = """
WITH ends AS (
  SELECT 'src' AS side, type, src_id AS node_id, dst_id AS other FROM edges UNION ALL SELECT 'dst', type, dst_id, src_id FROM edges
)"""

_P5 = """
WITH deliveries AS (
  SELECT repo_path, snapshot_no, lag(snapshot_no) OVER (PARTITION BY repo_path ORDER BY snapshot_no) AS before
  FROM (SELECT DISTINCT repo_path, snapshot_no FROM node_snapshots)
), records AS (
  SELECT 'nodes' AS tab, repo_path, id, snapshot_no, max(lower(hash)) AS mark FROM node_snapshots GROUP BY ALL
  UNION ALL SELECT DISTINCT 'edges', repo_path, id, snapshot_no, '' FROM edge_snapshots
), found AS (
  SELECT n.tab, n.repo_path, n.id, n.snapshot_no, CASE WHEN o.id IS NULL THEN 'added' ELSE 'changed' END AS change
  FROM records n JOIN deliveries d ON n.repo_path = d.repo_path AND n.snapshot_no = d.snapshot_no AND d.before IS NOT NULL
  LEFT JOIN records o ON o.tab = n.tab AND o.repo_path = n.repo_path AND o.id = n.id AND o.snapshot_no = d.before
  WHERE o.id IS NULL OR o.mark IS DISTINCT FROM n.mark
  UNION ALL
  SELECT o.tab, o.repo_path, o.id, d.snapshot_no, 'removed'
  FROM records o JOIN deliveries d ON o.repo_path = d.repo_path AND o.snapshot_no = d.before
  LEFT JOIN records n ON o.tab = n.tab AND o.repo_path = n.repo_path AND o.id = n.id AND n.snapshot_no = d.snapshot_no
  WHERE n.id IS NULL
)"""

_P6 = """
WITH RECURSIVE removals AS (
  SELECT DISTINCT repo_path, file, epoch_us(committed_at) AS at FROM commit_files WHERE change = 'D'
), versions AS (
  SELECT DISTINCT n.repo_path, n.id, n.updated_at * 1000000 AS born,
    (SELECT min(r.at) FROM removals r WHERE r.repo_path = n.repo_path AND r.file = n.file AND r.at > n.updated_at * 1000000) AS gone
  FROM nodes n
), refs AS (
  SELECT DISTINCT repo_path, id AS edge_id, type, field, CASE field WHEN 'src_id' THEN src_id ELSE dst_id END AS ref, CASE field WHEN 'src_id' THEN dst_id ELSE src_id END AS other,
    strftime(built_at AT TIME ZONE 'UTC', '%Y-%m') AS period, epoch_us(date_trunc('month', built_at AT TIME ZONE 'UTC') + INTERVAL 1 MONTH) AS month_end
  FROM edges, (VALUES ('src_id'), ('dst_id')) f(field)
), direct AS (
  SELECT r.* FROM refs r WHERE r.ref IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM versions v WHERE v.repo_path = r.repo_path AND v.id = r.ref AND v.born < r.month_end AND (v.gone IS NULL OR v.gone >= r.month_end))
), reached AS (
  SELECT repo_path, edge_id, type, field, other, period, 0 AS level FROM direct
  UNION
  SELECT r.repo_path, r.edge_id, r.type, r.field, r.other, r.period, o.level + 1
  FROM reached o JOIN refs r ON r.repo_path = o.repo_path AND r.ref = o.other AND r.period = o.period
  WHERE o.field = 'src_id' AND o.type IN ('has_method', 'has_field') AND o.level < 20
), found AS (
  SELECT repo_path, edge_id, field, period, min(level)::INTEGER AS level FROM reached GROUP BY ALL
)"""

SQL = {
    "p2_found": _P2 + " SELECT kind, repo_path, record_key FROM found",
    "p2_report": _P2 + " SELECT repo_path, kind, count(*) AS n_pending FROM found GROUP BY ALL",
    "p3_degree": _P3 + " SELECT side, type, node_id, count(*) AS degree FROM ends WHERE node_id IS NOT NULL AND type IS NOT NULL GROUP BY ALL",
    "p3_neighbours": _P3 + " SELECT side, type, node_id, count(DISTINCT other) AS neighbours FROM ends WHERE node_id IS NOT NULL AND type IS NOT NULL AND other IS NOT NULL GROUP BY ALL",
    "p3_found": _P3 + " SELECT side, type, node_id FROM ends WHERE node_id IS NOT NULL AND type IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)",
    "p5_found": _P5 + " SELECT * FROM found",
    "p5_report": _P5 + " SELECT tab, snapshot_no, change, count(*) AS n_records, count(DISTINCT repo_path) AS n_checkouts FROM found GROUP BY ALL",
    "p6_found": _P6 + " SELECT repo_path, edge_id, field, period FROM found WHERE level = 0",
    "p6_report": _P6 + " SELECT field, period, CASE level WHEN 0 THEN 'direct' ELSE 'inherited' END AS kind, level, count(*) AS n_references, count(DISTINCT repo_path) AS n_checkouts FROM found GROUP BY ALL",
}
