"""Queries over source files, exports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeweft import model
from codeweft.operators.graph import R
from codeweft.plans import export
from codeweft.queries.graph import _E, _N, _with, g
from codeweft.runtime import cut, table
from codeweft.sources import scan
from codeweft.sources.extract import extract, raw_facts
from codeweft.streaming import refresh


def extracted_nodes(s, d): return extract(table(s, d, "source_files"), facts=cut(raw_facts(table(s, d, "source_files"))))[0]
def extracted_edges(s, d): return extract(table(s, d, "source_files"), facts=cut(raw_facts(table(s, d, "source_files"))))[1]


def extracted_modules(s, d):
    """Modules of script and Python files by their path."""
    n = extract(table(s, d, "source_files").where(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin("ts", "js", "py")))[0]
    return n.where("type = 'Package'").select(R, "id")


def language_counts(s, d): return scan.language_counts(table(s, d, "source_files"))
def detected_languages(s, d): return scan.detect_languages(table(s, d, "source_files")).select(R, "language", "rank", "by")
def export_metadata(s, d): return export.metadata(g(s, d))
def export_rationale(s, d): return export.rationale_counts(g(s, d))


def _edge_stream(s, d): return s.readStream.schema(model.EDGES).parquet(f"{d}/edges.parque[t]")  # a pattern, so that it may be a file or a folder
def stream_degrees(s, d): return refresh.run_once(refresh.stream_degrees(_edge_stream(s, d)))
def stream_edge_counts(s, d): return refresh.run_once(refresh.stream_edge_counts(_edge_stream(s, d))).withColumn("window_start", F.unix_seconds("window_start"))


QUERIES = {f.__name__: f for f in (extracted_nodes, extracted_edges, extracted_modules, language_counts, detected_languages, export_metadata, export_rationale, stream_degrees, stream_edge_counts)}

_LANG = "CASE lower(regexp_extract(file, '\\.([^./]+)$', 1)) WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'py' THEN 'python' END"
_COUNTS = f"WITH c AS (SELECT repo_path, l AS language, count(DISTINCT file) AS n_files FROM (SELECT repo_path, file, {_LANG} AS l FROM source_files {{where}}) WHERE l IS NOT NULL GROUP BY 1, 2)"
_DIRS = "string_split(regexp_extract(file, '^(.*)/[^/]*$', 1), '/')"

SQL = {
    "extracted_modules": f"""SELECT DISTINCT repo_path, 'pkg:' || regexp_replace(replace(regexp_replace(file, '\\.\\w+$', ''), '/', '.'), CASE WHEN file LIKE '%.py' THEN '\\.__init__$' ELSE '\\.index$' END, '') AS id FROM source_files
 WHERE content IS NOT NULL AND lower(regexp_extract(file, '\\.([^./]+)$', 1)) IN ('ts', 'js', 'py') AND NOT list_has_any({_DIRS}, ['vendor', 'node_modules', '.git', 'target', 'build', 'dist', '__pycache__', 'venv', '.venv'])""",
    "language_counts": _COUNTS.format(where="") + " SELECT * FROM c",
    "detected_languages": _COUNTS.format(where=f"WHERE NOT list_has_any({_DIRS}, ['vendor', 'node_modules', '__pycache__']) AND NOT list_bool_or(list_transform({_DIRS}, lambda x: starts_with(x, '.')))")
    + """ SELECT repo_path, language, 1 AS rank, 'count' AS "by" FROM (SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY n_files DESC, list_position(['go', 'java', 'typescript', 'javascript', 'python'], language)) AS rn FROM c) WHERE rn = 1""",
    "export_metadata": _with(_N, _E) + """SELECT n.repo_path, count(*) AS node_count, coalesce(string_agg(DISTINCT nullif(json_extract_string(properties, '$.language'), ''), ',' ORDER BY nullif(json_extract_string(properties, '$.language'), '')), '') AS languages,
 coalesce(any_value(ec.k), 0) AS edge_count FROM n LEFT JOIN (SELECT repo_path, count(*) AS k FROM e GROUP BY 1) ec ON ec.repo_path = n.repo_path GROUP BY n.repo_path""",
    "export_rationale": _with(_N, _E) + """SELECT repo_path, target, count(*) AS n_rationale, arg_min(kind, (kind, text)) AS first_kind FROM (SELECT e.repo_path, e.dst_id AS target, coalesce(json_extract_string(n.properties, '$.kind'), '') AS kind, coalesce(json_extract_string(n.properties, '$.text'), '') AS text
 FROM e JOIN n ON n.repo_path = e.repo_path AND n.id = e.src_id WHERE e.type = 'explains') GROUP BY ALL""",
    "stream_degrees": "SELECT repo_path, id, count(*) AS degree FROM (SELECT repo_path, src_id AS id, eid FROM (SELECT DISTINCT repo_path, id AS eid, src_id, dst_id FROM edges) UNION ALL SELECT repo_path, dst_id, eid FROM (SELECT DISTINCT repo_path, id AS eid, src_id, dst_id FROM edges)) GROUP BY ALL",
    "stream_edge_counts": "SELECT (epoch_us(built_at) // 2592000000000) * 2592000 AS window_start, type, count(*) AS n_edges FROM edges GROUP BY ALL",
}
