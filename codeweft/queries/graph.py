"""Queries of the graph engine, each over all checkouts and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import columns as X
from codeweft.operators import analytics, enrich, graph, rendering, search, summaries, traversal, upserts
from codeweft.operators.graph import R, PropertyGraph
from codeweft.runtime import cut, table
from codeweft.sources.graph_tables import newest_build, newest_nodes, one_summary

QUESTION = "sizes of rows and the budget rows"
TARGET = "auth"


def g(s: SparkSession, d: str, fixed: bool = False) -> PropertyGraph:
    if not fixed:
        return PropertyGraph.of(table(s, d, "nodes"), table(s, d, "edges"))
    n = cut(nodes_of(s, d))
    return PropertyGraph(n, cut(graph.with_both_ends(graph.distinct_edges(table(s, d, "edges")), n)))


def nodes_of(s: SparkSession, d: str) -> DataFrame:
    return newest_nodes(table(s, d, "nodes"))


def sums(s: SparkSession, d: str) -> DataFrame:
    return one_summary(table(s, d, "summaries"))


def members(n: DataFrame) -> DataFrame:
    """A given partition: nodes by the first folder of their file, as the SQL twins have it. Nodes without a file are in no community.

    It stands in for communities where a twin has to follow; the louvain_ queries run the same operators over all nodes.
    """
    return analytics.renumber(n.where("file is not null").select(R, "id", F.split("file", "/")[0].alias("community")))


def old_nodes(s: SparkSession, d: str) -> DataFrame:
    """Oldest version of every node: the state before."""
    n = table(s, d, "nodes")
    rest = [c for c in n.columns if c not in (R, "id")]
    return n.groupBy(R, "id").agg(F.min_by(F.struct(*rest), F.struct("updated_at", "hash", "line_start", "properties")).alias("v")).select(R, "id", *[F.col(f"v.{c}").alias(c) for c in rest])


# --- graph core
def graph_nodes(s, d): return nodes_of(s, d)
def graph_edges(s, d): return g(s, d).edges.select(R, "id", "type", "src_id", "dst_id", "confidence", "properties")
def dangling_edges(s, d): return graph.rejected_edges(graph.distinct_edges(table(s, d, "edges")), nodes_of(s, d))
def id_conflicts(s, d): return graph.id_conflicts(table(s, d, "nodes"))
def merge_last_wins(s, d): return graph.merge_last_wins(nodes_of(s, d).where("type <> 'Function'").select(R, "id", "type", "hash"), old_nodes(s, d).select(R, "id", "type", "hash")).select(R, "id", "type", "hash")
def adjacency(s, d): return graph.adjacency(g(s, d))
def degree(s, d): return graph.degrees(g(s, d))
def god_nodes(s, d): return graph.hubs(graph.degrees(g(s, d)))
def god_flags(s, d): return graph.flag_hubs(graph.degrees(g(s, d))).groupBy(R, "god_node").agg(F.count(F.lit(1)).alias("n"), F.max("degree").alias("most"))
def visible_graph(s, d): return graph.visible(g(s, d)).edges.groupBy(R, "type").agg(F.count(F.lit(1)).alias("n_edges"))
def typed_graph(s, d): return graph.visible(g(s, d), ["Package", "Function"]).edges.select(R, "id")


# --- analytics
def pair_weights(s, d): return analytics.pair_weights(g(s, d))
def community_sizes(s, d): return members(nodes_of(s, d)).groupBy(R, "community").agg(F.count(F.lit(1)).alias("n_members"))


def community_labels(s, d):
    n = cut(nodes_of(s, d))
    return analytics.labels(n, cut(members(n)))


def cross_edges(s, d):
    x = g(s, d, True)
    return analytics.crossing_edges(x, members(x.nodes)).select(R, "id", "src_community", "dst_community", "pair_count")


def surprising_connections(s, d):
    x = g(s, d, True)
    return analytics.surprises(x, members(x.nodes)).select(R, "rank", "id", "pair_count")


def suggested_questions(s, d):
    x = g(s, d, True)
    m = cut(members(x.nodes))
    return analytics.questions(x, m, analytics.labels(x.nodes, m), graph.degrees(x))


def louvain_communities(s, d): return analytics.communities(g(s, d, True))


# The same over communities(), where every node has a community; without SQL twins.
def found_members(s: SparkSession, d: str) -> tuple[PropertyGraph, DataFrame]:
    x = g(s, d, True)
    return x, cut(analytics.communities(x))


def louvain_sizes(s, d): return louvain_communities(s, d).groupBy(R, "community").agg(F.count(F.lit(1)).alias("n_members"))


def louvain_labels(s, d):
    x, m = found_members(s, d)
    return analytics.labels(x.nodes, m)


def louvain_cross_edges(s, d): return analytics.crossing_edges(*found_members(s, d)).select(R, "id", "src_community", "dst_community", "pair_count")
def louvain_surprises(s, d): return analytics.surprises(*found_members(s, d)).select(R, "rank", "id", "pair_count")


def louvain_questions(s, d):
    x, m = found_members(s, d)
    return analytics.questions(x, m, analytics.labels(x.nodes, m), graph.degrees(x))


# --- search and traversal
def search_topk(s, d): return search.search(nodes_of(s, d), sums(s, d), QUESTION)
def resolve_target(s, d): return search.resolve(nodes_of(s, d), sums(s, d), TARGET)


def token_estimates(s, d):
    t = X.estimate_tokens("text")
    return table(s, d, "documents").select("doc_id", t.alias("tokens"))


def hub_targets(x: PropertyGraph) -> DataFrame:
    return graph.hubs(graph.degrees(x), 1).select(R, F.col("id").alias("target"))


def expand_hops(s, d):
    x = g(s, d, True)
    return traversal.expand(x, cut(hub_targets(x)), 2, cut(members(x.nodes)))


def louvain_expand(s, d):
    x, m = found_members(s, d)
    return traversal.expand(x, cut(hub_targets(x)), 2, m)


def local_graph(s, d):
    x = g(s, d, True)
    return traversal.local_edges(x, cut(hub_targets(x)), 1).select(R, "target", "id")


def path_pairs(x: PropertyGraph) -> DataFrame:
    """From the least to the greatest id of each checkout."""
    return x.nodes.groupBy(R).agg(F.min("id").alias("src"), F.max("id").alias("dst"))


def shortest_costs(s, d):
    x = g(s, d, True)
    return traversal.distances(x, path_pairs(x).select(R, "src")).groupBy(R, "src", "cost").agg(F.count(F.lit(1)).alias("n_nodes"))


def shortest_paths(s, d):
    x = g(s, d, True)
    return traversal.paths(x, cut(x.nodes.where("type = 'Function'").groupBy(R).agg(F.min("id").alias("src"), F.max("id").alias("dst"))))


def budget_cut(s, d):
    x = g(s, d, True)
    found = traversal.expand(x, cut(hub_targets(x)), 1)
    return rendering.within_budget(rendering.related_lines(x, found, sums(s, d)), 1000).select(R, "target", "rank", "id", "tokens", "running")


def relations(s, d):
    x = g(s, d)
    return rendering.relations(x, hub_targets(x))


def rationale_index(s, d): return rendering.rationale(g(s, d))


# --- store and increments
def hash_gate(s, d): return upserts.gate_nodes(old_nodes(s, d), nodes_of(s, d))


def edge_gate(s, d):
    e = table(s, d, "edges")
    first = e.groupBy(R, "id").agg(F.min_by(F.struct("confidence", "properties"), F.struct("built_at", "confidence", "properties")).alias("v")).select(R, "id", "v.*")
    return upserts.gate_edges(first, graph.distinct_edges(e)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def upserted_nodes(s, d): return upserts.upsert_nodes(old_nodes(s, d), nodes_of(s, d), 2_000_000_000).select(R, "id", "hash", "updated_at", "line_start")
def refreshed_properties(s, d): return upserts.refresh_properties(old_nodes(s, d), nodes_of(s, d)).select(R, "id", "hash", "properties")


def removed_files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "commit_files").where("change = 'D' and file is not null").select(R, "file").distinct()


def delete_by_file(s, d):
    n, e, m = upserts.delete_files(nodes_of(s, d), g(s, d).edges, sums(s, d), removed_files(s, d))
    part = lambda df, what: df.groupBy(R).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("tab", F.lit(what))
    return part(n, "nodes").unionByName(part(e, "edges")).unionByName(part(m, "summaries"))


def stale_marks(s, d):
    gone = graph.semi(nodes_of(s, d), removed_files(s, d), {R: R, "file": "file"})
    return upserts.mark_stale(sums(s, d), gone).groupBy("level", "stale").agg(F.count(F.lit(1)).alias("n"))


def upserted_summaries(s, d):
    m = sums(s, d)
    return upserts.upsert_summaries(m, m.where("stale = 1").withColumn("summary", F.lit("new"))).select(R, "node_id", "level", "summary", "stale")


def build_state(s, d): return newest_build(table(s, d, "build_meta"))


def catalog(s, d):
    n = nodes_of(s, d).groupBy(R).agg(F.count(F.lit(1)).alias("n_nodes"))
    e = graph.distinct_edges(table(s, d, "edges")).groupBy(R).agg(F.count(F.lit(1)).alias("n_edges"))
    b = newest_build(table(s, d, "build_meta"))
    out = graph.lookup(graph.lookup(b, n, {R: R}, {"n_nodes": "n_nodes"}), e, {R: R}, {"n_edges": "n_edges"}).fillna(0)
    status = F.when(F.col("last_commit").isNull(), "never-built").otherwise("built")
    return out.select(X.project_key(R).alias("project_key"), R, "last_commit", "n_nodes", "n_edges", status.alias("status"))


def invalidation_targets(s, d):
    old = old_nodes(s, d)
    e = graph.with_both_ends(graph.distinct_edges(table(s, d, "edges")), old)
    return summaries.invalidation_targets(PropertyGraph(old, e), nodes_of(s, d), removed_files(s, d))


def pending_nodes(s, d): return summaries.pending_nodes(nodes_of(s, d), sums(s, d)).select(R, "id", "type", "hash")
def pending_files(s, d): return summaries.pending_files(nodes_of(s, d), sums(s, d))
def pending_modules(s, d): return summaries.pending_modules(nodes_of(s, d), sums(s, d))


def apply_summaries(s, d):
    m = sums(s, d).where("level = 'node'").select(R, F.col("node_id").alias("id"), "hash", "summary")
    return summaries.apply_summaries("node", m, nodes_of(s, d), sums(s, d)).select(R, "id", "outcome")


def source_texts(s, d): return summaries.source_text(g(s, d, True))


# --- enrichment
def edge_confidence(s, d): return enrich.with_confidence(graph.distinct_edges(table(s, d, "edges"))).groupBy("type", "confidence").agg(F.count(F.lit(1)).alias("n"))


def nearest_entity(s, d):
    n = nodes_of(s, d)
    return enrich.nearest_entity(n.where("type = 'Rationale'"), n.where("type <> 'Rationale'"))


def rationale_nodes(s, d): return enrich.extract_rationale(table(s, d, "source_files")).select(R, "id", "line_end", "hash", "kind")


def explains_edges(s, d):
    r = enrich.extract_rationale(table(s, d, "source_files"))
    return enrich.explains(r, nodes_of(s, d).where("type <> 'Rationale'")).select(R, "id")


QUERIES = {f.__name__: f for f in (
    graph_nodes, graph_edges, dangling_edges, id_conflicts, merge_last_wins, adjacency, degree, god_nodes, god_flags, visible_graph, typed_graph, pair_weights, community_sizes, community_labels,
    cross_edges, surprising_connections, suggested_questions, louvain_communities, louvain_sizes, louvain_labels, louvain_cross_edges, louvain_surprises, louvain_questions, louvain_expand, search_topk, resolve_target, token_estimates, expand_hops, local_graph, shortest_costs, shortest_paths,
    budget_cut, relations, rationale_index, hash_gate, edge_gate, upserted_nodes, refreshed_properties, delete_by_file, stale_marks, upserted_summaries, build_state, catalog,
    invalidation_targets, pending_nodes, pending_files, pending_modules, apply_summaries, source_texts, edge_confidence, nearest_entity, rationale_nodes, explains_edges,
)}

_N = """n AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, id ORDER BY updated_at DESC, hash DESC NULLS LAST, line_start DESC NULLS LAST, properties DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1)"""
_O = """o AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, id ORDER BY updated_at, hash NULLS FIRST, line_start NULLS FIRST, properties NULLS FIRST) AS rn FROM nodes) WHERE rn = 1)"""
_E = """e0 AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, id ORDER BY built_at DESC, confidence DESC NULLS LAST, properties DESC NULLS LAST) AS rn FROM edges) WHERE rn = 1),
 e AS (SELECT * FROM e0 WHERE (repo_path, src_id) IN (SELECT (repo_path, id) FROM n) AND (repo_path, dst_id) IN (SELECT (repo_path, id) FROM n)),
 deg AS (SELECT n.repo_path, n.id, count(x.id)::INTEGER AS degree FROM n LEFT JOIN (SELECT repo_path, src_id AS id FROM e UNION ALL SELECT repo_path, dst_id FROM e) x ON n.repo_path = x.repo_path AND n.id = x.id GROUP BY ALL),
 hub AS (SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY degree DESC, id)::INTEGER AS rank FROM deg),
 w AS (SELECT repo_path, src_id AS nd, dst_id AS other, true AS outgoing, type, confidence, id AS edge_id, CASE WHEN type IN ('calls', 'has_method') THEN 3 WHEN type IN ('has_field', 'maps_to_table', 'references_fk', 'reads_table', 'writes_table', 'exposes_endpoint', 'embeds', 'implements') THEN 2 ELSE 1 END AS weight FROM e WHERE src_id <> dst_id),
 u AS (SELECT * FROM w UNION ALL SELECT repo_path, other, nd, false, type, confidence, edge_id, weight FROM w)"""
_S = """s AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, node_id, level ORDER BY stale, hash DESC NULLS LAST, summary DESC NULLS LAST, model DESC NULLS LAST) AS rn FROM summaries) WHERE rn = 1)"""
_M = """mc AS (SELECT repo_path, split_part(file, '/', 1) AS c, count(*) AS n_members, min(id) AS least FROM n WHERE file IS NOT NULL GROUP BY 1, 2),
 mn AS (SELECT *, (row_number() OVER (PARTITION BY repo_path ORDER BY n_members DESC, least) - 1)::INTEGER AS community FROM mc),
 m AS (SELECT n.repo_path, n.id, n.file, n.type, n.properties, mn.community FROM n JOIN mn ON n.repo_path = mn.repo_path AND split_part(n.file, '/', 1) = mn.c)"""
_NAME = "coalesce(json_extract_string(properties, '$.name'), '')"
_STOP = "['internal', 'pkg', 'src', 'cmd', 'lib', 'test', 'tests', 'main', 'app', 'com', 'org', 'io', 'net', 'util', 'utils', 'common', 'core']"
_L = f"""lw AS (SELECT repo_path, community, w, count(*) AS n FROM (
   SELECT repo_path, community, unnest(list_concat(string_split(lower(regexp_replace(regexp_extract(file, '^(.*)/[^/]*$', 1), '[^a-zA-Z0-9]+', ' ', 'g')), ' '), string_split(lower(regexp_replace(regexp_extract({_NAME}, '^(.*)/[^/]*$', 1), '[^a-zA-Z0-9]+', ' ', 'g')), ' '))) AS w FROM m
  ) WHERE length(w) >= 3 AND NOT list_contains({_STOP}, w) GROUP BY ALL),
 lt AS (SELECT repo_path, community, w, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, community ORDER BY n DESC, w) AS rn FROM lw) WHERE rn = 1),
 ly AS (SELECT repo_path, community, type FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, community ORDER BY n DESC, type) AS rn FROM (SELECT repo_path, community, type, count(*) AS n FROM m GROUP BY ALL)) WHERE rn = 1),
 lab AS (SELECT mn.repo_path, mn.community, CASE WHEN lt.n * 2 >= mn.n_members THEN upper(lt.w[1]) || lt.w[2:] ELSE coalesce(ly.type || 's', 'Misc') END AS label, mn.n_members FROM mn LEFT JOIN lt USING (repo_path, community) LEFT JOIN ly USING (repo_path, community))"""
_X = """x0 AS (SELECT e.*, a.community AS src_community, b.community AS dst_community FROM e JOIN m a ON e.repo_path = a.repo_path AND e.src_id = a.id JOIN m b ON e.repo_path = b.repo_path AND e.dst_id = b.id WHERE a.community <> b.community),
 x AS (SELECT *, count(*) OVER (PARTITION BY repo_path, least(src_community, dst_community), greatest(src_community, dst_community)) AS pair_count FROM x0)"""
_GONE = "gone AS (SELECT DISTINCT repo_path, file FROM commit_files WHERE change = 'D' AND file IS NOT NULL)"
_TYPES = "('Struct', 'Interface', 'Function', 'Table', 'Endpoint', 'ExternalDependency', 'Enum', 'Decorator', 'Variable', 'TypeAlias')"
_SPAN = "('Struct', 'Interface', 'Function', 'Enum', 'Decorator', 'Variable', 'TypeAlias')"


def _score(query: str) -> str:
    q = search.terms(query)
    return " + ".join(f"{q.count(t)} * len(list_filter(t, lambda x: x = '{t}'))" for t in sorted(set(q)))


def _scored(query: str) -> str:
    return f"""tx AS (SELECT n.repo_path, n.id, regexp_extract_all(lower(concat_ws(' ', nullif(s.summary, ''), coalesce(n.signature, ''), nullif(json_extract_string(n.properties, '$.name'), ''))), '[a-z0-9_]+') AS t
   FROM n LEFT JOIN s ON s.repo_path = n.repo_path AND s.node_id = n.id AND s.level = 'node' WHERE n.type IN {_TYPES}),
 sc AS (SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY score DESC, id)::INTEGER AS rank FROM (SELECT repo_path, id, ({_score(query)})::INTEGER AS score FROM tx) WHERE score > 0)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n ".join(parts) + "\n"


_EXPAND = """lv AS (SELECT repo_path, id AS target, id, 0 AS hop FROM hub WHERE rank = 1
   UNION SELECT l.repo_path, l.target, u.other, l.hop + 1 FROM lv l JOIN u ON u.repo_path = l.repo_path AND u.nd = l.id WHERE l.hop < {hops}),
 lf AS (SELECT repo_path, target, id, min(hop)::INTEGER AS hop FROM lv GROUP BY ALL),
 ed AS (SELECT f.repo_path, f.target, u.other AS id, u.weight + {boost} AS weight, u.nd, u.type, u.outgoing, u.confidence,
   row_number() OVER (PARTITION BY f.repo_path, f.target, u.other ORDER BY u.weight + {boost} DESC, f.hop, u.nd, NOT u.outgoing, u.edge_id) AS rn
   FROM lf f JOIN u ON u.repo_path = f.repo_path AND u.nd = f.id {members} WHERE f.hop < {hops}),
 ex AS (SELECT f.repo_path, f.target, f.id, f.hop, coalesce(b.weight, 0)::INTEGER AS weight, b.nd AS parent_id, b.type AS via_edge, b.outgoing, b.confidence
   FROM lf f LEFT JOIN ed b ON b.repo_path = f.repo_path AND b.target = f.target AND b.id = f.id AND b.rn = 1)"""
_BOOST = "(CASE WHEN tm.community = om.community THEN 1 ELSE 0 END)"
_BOOST_JOIN = "LEFT JOIN m tm ON tm.repo_path = f.repo_path AND tm.id = f.target LEFT JOIN m om ON om.repo_path = f.repo_path AND om.id = u.other"
_LINE = """ln AS (SELECT x.*, CASE WHEN bytes = 0 THEN 0 ELSE bytes // 3 + 1 END AS tokens FROM (SELECT ex.repo_path, ex.target, ex.id, ex.hop, ex.weight, strlen(
   CASE WHEN ex.parent_id IS NULL THEN '- [seed] ' || ex.id ELSE '- [hop ' || ex.hop || '] ' || CASE WHEN ex.outgoing THEN ex.parent_id ELSE ex.id END || ' --' || ex.via_edge || '(' || coalesce(nullif(ex.confidence, ''), '?') || ')--> ' || CASE WHEN ex.outgoing THEN ex.id ELSE ex.parent_id END END
   || ' (' || n.type || '): ' || coalesce(nullif(s.summary, ''), '(no summary yet)') || chr(10)) AS bytes
   FROM ex JOIN n ON n.repo_path = ex.repo_path AND n.id = ex.id LEFT JOIN s ON s.repo_path = ex.repo_path AND s.node_id = ex.id AND s.level = 'node' WHERE ex.id <> ex.target) x)"""

SQL = {
    "graph_nodes": _with(_N) + "SELECT * FROM n",
    "graph_edges": _with(_N, _E) + "SELECT repo_path, id, type, src_id, dst_id, confidence, properties FROM e",
    "dangling_edges": _with(_N, _E) + "SELECT * FROM (SELECT repo_path, id, (repo_path, src_id) NOT IN (SELECT (repo_path, id) FROM n) AS src_missing, (repo_path, dst_id) NOT IN (SELECT (repo_path, id) FROM n) AS dst_missing FROM e0) WHERE src_missing OR dst_missing",
    "id_conflicts": "SELECT repo_path, id, count(*) AS n_rows, count(DISTINCT hash) AS n_hashes, count(DISTINCT type) AS n_types FROM nodes GROUP BY ALL HAVING count(*) > 1",
    "merge_last_wins": _with(_O) + "SELECT repo_path, id, type, hash FROM o",
    "adjacency": _with(_N, _E) + "SELECT repo_path, id, type, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT repo_path, src_id AS id, type, 1 AS o, 0 AS i FROM e UNION ALL SELECT repo_path, dst_id, type, 0, 1 FROM e) GROUP BY ALL",
    "degree": _with(_N, _E) + "SELECT * FROM deg",
    "god_nodes": _with(_N, _E) + "SELECT * FROM hub WHERE rank <= 10",
    "god_flags": _with(_N, _E) + "SELECT repo_path, rank <= 10 AS god_node, count(*) AS n, max(degree) AS most FROM hub GROUP BY ALL",
    "visible_graph": _with(_N, _E) + "SELECT e.repo_path, e.type, count(*) AS n_edges FROM e JOIN n a ON a.repo_path = e.repo_path AND a.id = src_id JOIN n b ON b.repo_path = e.repo_path AND b.id = dst_id WHERE a.type NOT IN ('Field', 'Column') AND b.type NOT IN ('Field', 'Column') GROUP BY ALL",
    "typed_graph": _with(_N, _E) + "SELECT e.repo_path, e.id FROM e JOIN n a ON a.repo_path = e.repo_path AND a.id = src_id JOIN n b ON b.repo_path = e.repo_path AND b.id = dst_id WHERE a.type IN ('Package', 'Function') AND b.type IN ('Package', 'Function')",
    "pair_weights": _with(_N, _E) + "SELECT repo_path, least(src_id, dst_id) AS a, greatest(src_id, dst_id) AS b, count(*) AS weight FROM e WHERE src_id <> dst_id GROUP BY ALL",
    "community_sizes": _with(_N, _M) + "SELECT repo_path, community, n_members FROM mn",
    "community_labels": _with(_N, _M, _L) + "SELECT * FROM lab",
    "cross_edges": _with(_N, _E, _M, _X) + "SELECT repo_path, id, src_community, dst_community, pair_count FROM x",
    "surprising_connections": _with(_N, _E, _M, _X) + "SELECT * FROM (SELECT repo_path, row_number() OVER (PARTITION BY repo_path ORDER BY pair_count, id)::INTEGER AS rank, id, pair_count FROM x) WHERE rank <= 10",
    "suggested_questions": _with(_N, _E, _M, _L, _X) + """, q AS (
   SELECT repo_path, 0 AS part, 0 AS x, '' AS y, 'What does `' || id || '` do, and why is it so central (degree ' || degree || ')?' AS question FROM hub WHERE rank = 1 AND degree > 0
   UNION ALL SELECT repo_path, 1, x, y, q FROM (SELECT x.repo_path, pair_count AS x, x.id AS y, 'What connects ' || a.label || ' to ' || b.label || '?' AS q, row_number() OVER (PARTITION BY x.repo_path, least(a.label, b.label), greatest(a.label, b.label) ORDER BY pair_count, x.id) AS rn
     FROM x JOIN lab a ON a.repo_path = x.repo_path AND a.community = x.src_community JOIN lab b ON b.repo_path = x.repo_path AND b.community = x.dst_community) WHERE rn = 1
   UNION ALL SELECT repo_path, 2, community, '', 'What is the responsibility of the ' || label || ' subsystem?' FROM lab)
 SELECT repo_path, rank, question FROM (SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY part, x, y)::INTEGER AS rank FROM q) WHERE rank <= 5""".replace(", q AS", ", q AS", 1),
    "search_topk": _with(_N, _S, _scored(QUESTION)) + "SELECT repo_path, id, score, rank FROM sc WHERE rank <= 10",
    "resolve_target": _with(_N, _S, _scored(TARGET)) + f""", f AS (SELECT * FROM n WHERE file = '{TARGET}' OR regexp_extract(file, '[^/]*$') = '{TARGET}'),
 c AS (SELECT repo_path, min(id) AS id, 'id' AS how, 0 AS o FROM n WHERE id = '{TARGET}' GROUP BY 1 UNION ALL SELECT repo_path, min(id), 'name', 1 FROM n WHERE {_NAME} = '{TARGET}' GROUP BY 1
   UNION ALL SELECT f.repo_path, min(p.id), 'package', 2 FROM f JOIN n p ON p.repo_path = f.repo_path AND p.id = 'pkg:' || json_extract_string(f.properties, '$.package') GROUP BY 1
   UNION ALL SELECT repo_path, min(id), 'file', 3 FROM f GROUP BY 1 UNION ALL SELECT repo_path, id, 'search', 4 FROM sc WHERE rank = 1)
 SELECT repo_path, arg_min(id, o) AS id, arg_min(how, o) AS how FROM c GROUP BY 1""",
    "token_estimates": "SELECT doc_id, CASE WHEN coalesce(strlen(text), 0) = 0 THEN 0 ELSE (strlen(text) // 3 + 1)::INTEGER END AS tokens FROM documents",
    "expand_hops": _with(_N, _E, _M, _EXPAND.format(hops=2, boost=_BOOST, members=_BOOST_JOIN), recursive=True) + "SELECT * FROM ex",
    "local_graph": _with(_N, _E, _EXPAND.format(hops=1, boost=0, members=""), recursive=True) + "SELECT a.repo_path, a.target, e.id FROM e JOIN lf a ON a.repo_path = e.repo_path AND a.id = e.src_id JOIN lf b ON b.repo_path = e.repo_path AND b.target = a.target AND b.id = e.dst_id",
    "shortest_costs": _with(_N, _E, """t AS (SELECT repo_path, nd, other, min(4 - weight) AS c FROM u GROUP BY ALL), src AS (SELECT repo_path, min(id) AS src FROM n GROUP BY 1),
 r AS (SELECT repo_path, src, src AS id, 0 AS cost FROM src UNION SELECT r.repo_path, r.src, t.other, r.cost + t.c FROM r JOIN t ON t.repo_path = r.repo_path AND t.nd = r.id WHERE r.cost < 60)""", recursive=True)
    + "SELECT repo_path, src, cost, count(*) AS n_nodes FROM (SELECT repo_path, src, id, min(cost)::INTEGER AS cost FROM r GROUP BY ALL) GROUP BY ALL",
    "budget_cut": _with(_N, _E, _S, _EXPAND.format(hops=1, boost=0, members=""), _LINE, recursive=True)
    + """SELECT repo_path, target, rank, id, tokens::INTEGER AS tokens, running FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, target ORDER BY hop, weight DESC, id)::INTEGER AS rank,
   (sum(tokens) OVER (PARTITION BY repo_path, target ORDER BY hop, weight DESC, id))::BIGINT AS running FROM ln) WHERE running <= 1000 OR rank = 1""",
    "relations": _with(_N, _E) + "SELECT e.repo_path, h.id AS target, 'out' AS direction, type, dst_id AS other, coalesce(nullif(confidence, ''), '?') AS confidence FROM e JOIN hub h ON h.repo_path = e.repo_path AND h.id = src_id AND rank = 1 UNION ALL SELECT e.repo_path, h.id, 'in', type, src_id, coalesce(nullif(confidence, ''), '?') FROM e JOIN hub h ON h.repo_path = e.repo_path AND h.id = dst_id AND rank = 1",
    "rationale_index": _with(_N, _E) + "SELECT e.repo_path, e.dst_id AS target, e.src_id AS rationale_id, coalesce(json_extract_string(n.properties, '$.kind'), '') AS kind, coalesce(json_extract_string(n.properties, '$.text'), '') AS text FROM e JOIN n ON n.repo_path = e.repo_path AND n.id = e.src_id WHERE e.type = 'explains'",
    "hash_gate": _with(_N, _O) + "SELECT repo_path, id, CASE WHEN n.hash IS DISTINCT FROM o.hash THEN 'written' ELSE 'unchanged' END AS state FROM n JOIN o USING (repo_path, id)",
    "edge_gate": """WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, id ORDER BY built_at, confidence NULLS FIRST, properties NULLS FIRST) AS f, row_number() OVER (PARTITION BY repo_path, id ORDER BY built_at DESC, confidence DESC NULLS LAST, properties DESC NULLS LAST) AS l FROM edges)),
 k AS (SELECT repo_path, id, coalesce(nullif(confidence, ''), 'EXTRACTED') AS c, coalesce(json(properties)::VARCHAR, 'null') AS p, f, l FROM a)
 SELECT CASE WHEN x.c <> y.c OR x.p <> y.p THEN 'written' ELSE 'unchanged' END AS state, count(*) AS n FROM k x JOIN k y ON x.repo_path = y.repo_path AND x.id = y.id AND x.f = 1 AND y.l = 1 GROUP BY ALL""",
    "upserted_nodes": _with(_N, _O) + "SELECT repo_path, id, n.hash, CASE WHEN n.hash IS DISTINCT FROM o.hash THEN 2000000000 ELSE o.updated_at END AS updated_at, CASE WHEN n.hash IS DISTINCT FROM o.hash THEN n.line_start ELSE o.line_start END AS line_start FROM n JOIN o USING (repo_path, id)",
    "refreshed_properties": _with(_N, _O) + "SELECT repo_path, id, o.hash, n.properties FROM n JOIN o USING (repo_path, id)",
    "delete_by_file": _with(_N, _E, _S, _GONE, "d AS (SELECT repo_path, id FROM n WHERE (repo_path, file) IN (SELECT (repo_path, file) FROM gone))")
    + """SELECT repo_path, 'nodes' AS tab, count(*) AS n_rows FROM n WHERE (repo_path, id) NOT IN (SELECT (repo_path, id) FROM d) GROUP BY ALL
 UNION ALL SELECT repo_path, 'edges', count(*) FROM e WHERE (repo_path, src_id) NOT IN (SELECT (repo_path, id) FROM d) AND (repo_path, dst_id) NOT IN (SELECT (repo_path, id) FROM d) GROUP BY ALL
 UNION ALL SELECT repo_path, 'summaries', count(*) FROM s WHERE (repo_path, node_id) NOT IN (SELECT (repo_path, id) FROM d) GROUP BY ALL""",
    "stale_marks": _with(_N, _S, _GONE, "d AS (SELECT repo_path, id FROM n WHERE (repo_path, file) IN (SELECT (repo_path, file) FROM gone))") + "SELECT level, CASE WHEN level = 'node' AND (repo_path, node_id) IN (SELECT (repo_path, id) FROM d) THEN 1 ELSE stale END AS stale, count(*) AS n FROM s GROUP BY ALL",
    "upserted_summaries": _with(_S) + "SELECT repo_path, node_id, level, CASE WHEN stale = 1 THEN 'new' ELSE summary END AS summary, 0 AS stale FROM s",
    "build_state": "SELECT repo_path, nullif(trim(arg_max(coalesce(last_commit, ''), coalesce(last_build_at, -1))), '') AS last_commit FROM build_meta GROUP BY 1",
    "catalog": _with(_N, _E, "b AS (SELECT repo_path, nullif(trim(arg_max(coalesce(last_commit, ''), coalesce(last_build_at, -1))), '') AS last_commit FROM build_meta GROUP BY 1)")
    + """SELECT left(sha256(b.repo_path), 16) AS project_key, b.repo_path, last_commit, (SELECT count(*) FROM n WHERE n.repo_path = b.repo_path) AS n_nodes, (SELECT count(*) FROM e0 WHERE e0.repo_path = b.repo_path) AS n_edges,
   CASE WHEN last_commit IS NULL THEN 'never-built' ELSE 'built' END AS status FROM b""",
    "invalidation_targets": _with(_N, _O, _E, "oe AS (SELECT * FROM e0)", "sd AS (SELECT n.repo_path, n.id FROM n LEFT JOIN o USING (repo_path, id) WHERE coalesce(o.hash, '') <> coalesce(n.hash, ''))")
    + "SELECT repo_path, id FROM sd UNION SELECT u.repo_path, u.other FROM u JOIN sd ON sd.repo_path = u.repo_path AND sd.id = u.nd",
    "pending_nodes": _with(_N, _S) + f"SELECT repo_path, id, type, hash FROM n WHERE type IN {_TYPES} AND NOT EXISTS (SELECT 1 FROM s WHERE s.repo_path = n.repo_path AND s.node_id = n.id AND s.level = 'node' AND s.stale = 0 AND s.hash = n.hash)",
    "pending_files": _with(_N, _S) + f"""SELECT f.repo_path, f.file AS id, f.h AS hash, f.n_children FROM (SELECT n.repo_path, n.file, bool_and(coalesce(s.hash = n.hash, false)) AS complete, count(*)::INTEGER AS n_children, sha256(string_agg(n.id || ':' || n.hash, '|' ORDER BY n.id)) AS h
   FROM n LEFT JOIN s ON s.repo_path = n.repo_path AND s.node_id = n.id AND s.level = 'node' WHERE n.type IN {_SPAN} AND coalesce(n.file, '') <> '' GROUP BY 1, 2) f
 LEFT JOIN s ON s.repo_path = f.repo_path AND s.node_id = f.file AND s.level = 'file' WHERE f.complete AND s.hash IS DISTINCT FROM f.h""",
    "pending_modules": _with(_N, _S) + f""", k AS (SELECT DISTINCT repo_path, json_extract_string(properties, '$.package') AS package, file FROM n WHERE type IN {_SPAN} AND coalesce(file, '') <> '')
 SELECT f.repo_path, f.id, f.h AS hash, f.n_files FROM (SELECT k.repo_path, 'pkg:' || k.package AS id, bool_and(s.hash IS NOT NULL) AS complete, count(*)::INTEGER AS n_files, sha256(string_agg(k.file || ':' || s.hash, '|' ORDER BY k.file)) AS h
   FROM k LEFT JOIN s ON s.repo_path = k.repo_path AND s.node_id = k.file AND s.level = 'file' WHERE coalesce(k.package, '') <> '' GROUP BY 1, 2) f
 LEFT JOIN s ON s.repo_path = f.repo_path AND s.node_id = f.id AND s.level = 'module' WHERE f.complete AND s.hash IS DISTINCT FROM f.h""",
    "apply_summaries": _with(_N, _S) + "SELECT s.repo_path, s.node_id AS id, CASE WHEN n.id IS NULL THEN 'unknown id' WHEN n.hash IS NOT DISTINCT FROM s.hash THEN 'applied' ELSE 'hash mismatch (code changed since export)' END AS outcome FROM s LEFT JOIN n ON n.repo_path = s.repo_path AND n.id = s.node_id WHERE s.level = 'node'",
    "edge_confidence": _with(_N, _E) + "SELECT type, coalesce(nullif(confidence, ''), CASE WHEN type IN ('implements', 'maps_to_table', 'reads_table', 'writes_table', 'injected', 'decorated', 'routed', 'explains') THEN 'INFERRED' ELSE 'EXTRACTED' END) AS confidence, count(*) AS n FROM e0 GROUP BY ALL",
    "nearest_entity": _with(_N, "r AS (SELECT * FROM n WHERE type = 'Rationale' AND file IS NOT NULL AND line_end IS NOT NULL)", "t AS (SELECT * FROM n WHERE type <> 'Rationale' AND file IS NOT NULL AND line_start IS NOT NULL)")
    + """SELECT r.repo_path, r.id, coalesce(arg_min(t.id, (t.line_start, t.id)) FILTER (t.line_start >= r.line_end), arg_max(t.id, (t.line_start, t.id))) AS entity FROM r JOIN t ON t.repo_path = r.repo_path AND t.file = r.file GROUP BY r.repo_path, r.id""",
    "source_texts": _with(_N, _E, """cl AS (SELECT e.repo_path, e.src_id AS id, string_agg(DISTINCT line, chr(10) ORDER BY line) AS cols FROM (
   SELECT e.repo_path, e.src_id, concat_ws(' ', '- ' || regexp_extract(e.dst_id, '[^./]*$'), nullif(json_extract_string(c.properties, '$.sql_type'), '')) AS line
   FROM e JOIN n t ON t.repo_path = e.repo_path AND t.id = e.src_id AND t.type = 'Table' JOIN n c ON c.repo_path = e.repo_path AND c.id = e.dst_id WHERE e.type = 'has_field') e GROUP BY 1, 2)""",
   """rf AS (SELECT repo_path, dst_id AS id, string_agg(DISTINCT src_id, ', ' ORDER BY src_id) AS refs FROM e WHERE type = 'references_fk' GROUP BY 1, 2)""",
   """hd AS (SELECT repo_path, id, min(h) AS h FROM (SELECT repo_path, dst_id AS id, src_id AS h FROM e WHERE type IN ('exposes_endpoint', 'routed') UNION ALL SELECT repo_path, src_id, dst_id FROM e WHERE type IN ('exposes_endpoint', 'routed')) GROUP BY 1, 2)""")
    + """SELECT n.repo_path, n.id, CASE n.type WHEN 'Table' THEN 'Table ' || n.id[7:] || coalesce(chr(10) || 'Columns:' || chr(10) || cols, '') || coalesce(chr(10) || 'Referenced by: ' || refs, '')
   WHEN 'Endpoint' THEN 'Endpoint ' || n.id[10:] || coalesce(chr(10) || 'Handler: ' || h, '') WHEN 'ExternalDependency' THEN 'External dependency ' || n.id[5:] || coalesce('@' || nullif(json_extract_string(n.properties, '$.version'), ''), '')
   ELSE n.type || ' ' || coalesce(nullif(n.signature, ''), n.id) END AS source
 FROM n LEFT JOIN cl ON cl.repo_path = n.repo_path AND cl.id = n.id LEFT JOIN rf ON rf.repo_path = n.repo_path AND rf.id = n.id LEFT JOIN hd ON hd.repo_path = n.repo_path AND hd.id = n.id
 WHERE n.type IN ('Table', 'Endpoint', 'ExternalDependency', 'Enum', 'Decorator', 'Variable', 'TypeAlias')""",
}
