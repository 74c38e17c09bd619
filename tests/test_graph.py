"""Graph core, traversal, communities, search, rendering and upserts on small graphs, with sequential restatements."""

import heapq
import itertools
import random
from datetime import UTC, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeweft import model
from codeweft.functions import columns as X
from codeweft.model import EDGES, NODES, SUMMARIES
from codeweft.operators import analytics, enrich, graph, rendering, search, summaries, traversal, upserts
from codeweft.operators.graph import PropertyGraph

T0 = datetime(2025, 1, 1, tzinfo=UTC)


def N(id, type="Function", file=None, props=None, hash="h", repo="r", at=1, sig=None, lines=(None, None)):
    return (repo, id, type, file, *lines, sig, hash, props, at)


def E(type, src, dst, repo="r", conf="EXTRACTED", id=None, props=None):
    return (repo, id or f"{type}|{src}|{dst}", type, src, dst, conf, props, T0)


def G(spark, nodes, edges):
    return PropertyGraph.of(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CHAIN_N = [N("pkg:demo", "Package"), N("demo.A()", props='{"name":"A"}', sig="func A()"), N("demo.B()"), N("demo.C()"), N("demo.Order", "Struct"), N("table:orders", "Table")]
CHAIN_E = [E("calls", "demo.A()", "demo.B()"), E("calls", "demo.B()", "demo.C()"), E("maps_to_table", "demo.Order", "table:orders")]


def one(spark, target):
    return spark.createDataFrame([("r", target)], "repo_path string, target string")


def test_edges_need_both_ends_and_newest_versions_count(spark):
    g = G(spark, [N("a", hash="1", at=1), N("a", hash="2", at=2), N("a", hash="2", at=2), N("b"), N("b", repo="q")], [E("calls", "a", "b"), E("calls", "a", "b"), E("calls", "a", "x"), E("calls", None, "b"), E("calls", "a", "a")])
    assert {r.id: r.hash for r in g.nodes.where("repo_path = 'r'").collect()} == {"a": "2", "b": "h"}
    assert rows(g.edges.select("id")) == [("calls|a|a",), ("calls|a|b",)]
    assert rows(graph.degrees(g).where("repo_path = 'r'").select("id", "degree")) == [("a", 3), ("b", 1)]
    bad = graph.rejected_edges(spark.createDataFrame([E("calls", "a", "x"), E("calls", "a", "b")], EDGES), g.nodes)
    assert rows(bad.select("id", "src_missing", "dst_missing")) == [("calls|a|x", False, True)]
    assert graph.degrees(G(spark, [], [])).count() == 0


def test_merge_and_conflicts(spark):
    a, b = spark.createDataFrame([N("a", "Struct"), N("c")], NODES), spark.createDataFrame([N("a", "Table"), N("d")], NODES)
    assert rows(graph.merge_last_wins(a, b).select("id", "type")) == [("a", "Table"), ("c", "Function"), ("d", "Function")]
    assert rows(graph.id_conflicts(a.unionByName(b)).select("id", "n_types")) == [("a", 2)]


def test_hubs_and_views(spark):
    g = G(spark, [N("a"), N("b"), N("f", "Field"), N("p", "Package")], [E("calls", "a", "b"), E("has_field", "a", "f"), E("imports", "p", "a")])
    assert [r.id for r in graph.hubs(graph.degrees(g), 2).orderBy("rank").collect()] == ["a", "b"]
    assert rows(graph.flag_hubs(graph.degrees(g), 1).where("god_node").select("id")) == [("a",)]
    assert rows(graph.visible(g).edges.select("id")) == [("calls|a|b",), ("imports|p|a",)]
    assert graph.visible(g, ["all"]).edges.count() == 3
    assert rows(graph.visible(g, ["Function"]).nodes.select("id")) == [("a",), ("b",)]


def test_expand_chain_and_boost(spark):
    g = G(spark, CHAIN_N, CHAIN_E)
    out = {r.id: (r.hop, r.weight, r.parent_id) for r in traversal.expand(g, one(spark, "demo.A()"), 2).collect()}
    assert out == {"demo.A()": (0, 3, "demo.B()"), "demo.B()": (1, 3, "demo.A()"), "demo.C()": (2, 3, "demo.B()")}
    m = spark.createDataFrame([("r", "demo.A()", 0), ("r", "demo.B()", 0), ("r", "demo.C()", 1)], "repo_path string, id string, community int")
    out = {r.id: r.weight for r in traversal.expand(g, one(spark, "demo.A()"), 2, m).collect()}
    assert out["demo.B()"] == 4 and out["demo.C()"] == 3
    assert rows(traversal.local_edges(g, one(spark, "demo.A()"), 1).select("id")) == [("calls|demo.A()|demo.B()",)]


def sequential_costs(edges, src):
    near = {}
    for kind, a, b in edges:
        w = next((w for w, ts in model.WEIGHTS.items() if kind in ts), 1)
        for x, y in ((a, b), (b, a)):
            if x != y:
                near.setdefault(x, []).append((y, 4 - w))
    best, heap = {}, [(0, src)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in best:
            continue
        best[x] = d
        for y, c in near.get(x, ()):
            heapq.heappush(heap, (d + c, y))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_equal_sequential_dijkstra(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{k}" for k in range(14)]
    es = {(rnd.choice(model.EDGE_TYPES), rnd.choice(ids), rnd.choice(ids)) for _ in range(22)}
    g = G(spark, [N(i) for i in ids], [E(*e) for e in es])
    want = sequential_costs(es, "n0")
    got = {r.id: r.cost for r in traversal.distances(g, spark.createDataFrame([("r", "n0")], "repo_path string, src string")).collect()}
    assert got == want
    pairs = [("r", "n0", d) for d in ids] + [("r", "n0", "nowhere"), ("r", "nowhere", "n0")]
    told = {}
    for r in traversal.paths(g, spark.createDataFrame(pairs, "repo_path string, src string, dst string")).orderBy("dst", "hop_no").collect():
        told.setdefault(r.dst, []).append(r)
    assert set(told) == {d for d in ids if d in want}
    links = {frozenset((a, b)) for _, a, b in es}
    for d, steps in told.items():
        assert steps[0].id == "n0" and steps[-1].id == d and steps[-1].cost == want[d] and [s.hop_no for s in steps] == list(range(len(steps)))
        assert all(frozenset((x.id, y.id)) in links and y.via_edge for x, y in itertools.pairwise(steps))


def cliques(bridges=()):
    ids = {c: [f"{c}{k}" for k in range(1, 5)] for c in "ab"}
    n = [N(i, file=f"pkg/{c}/x.go") for c, xs in ids.items() for i in xs]
    return n, [E("calls", x, y) for xs in ids.values() for x, y in itertools.combinations(xs, 2)] + [E("calls", x, y, id=i) for i, x, y in bridges]


def test_louvain_and_labels(spark):
    g = G(spark, *cliques())
    m = analytics.communities(g)
    assert rows(m.select("id", "community")) == sorted([(f"a{k}", 0) for k in range(1, 5)] + [(f"b{k}", 1) for k in range(1, 5)])
    assert rows(analytics.labels(g.nodes, m).select("community", "label", "n_members")) == [(0, "Functions", 4), (1, "Functions", 4)]
    bridged = G(spark, *cliques([("bridge", "a1", "b1"), ("boost1", "b1", "b2"), ("boost2", "b1", "b3")]))
    n = lambda r: analytics.communities(bridged, r).select("community").distinct().count()
    assert n(0.1) < n(1.0)
    assert rows(analytics.surprises(bridged, analytics.communities(bridged)).select("id", "pair_count")) == [("bridge", 1)]
    lone = analytics.communities(G(spark, [N("x"), N("y")], []))
    assert rows(lone.select("id", "community")) == [("x", 0), ("y", 1)]


def test_nodes_without_a_file_have_communities(spark, tmp_path):
    from codeweft.queries import graph as queries

    n, e = cliques()
    n += [N("ext:lib", "ExternalDependency"), *[N(f"ext:{k}", "ExternalDependency") for k in range(1, 4)]]
    e += [E("imports", f"ext:{k}", "ext:lib") for k in range(1, 4)] + [E("imports", "a1", "ext:lib")]
    spark.createDataFrame(n, NODES).write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame(e, EDGES).write.parquet(f"{tmp_path}/edges.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(r.n_members for r in run("louvain_sizes").collect()) == [4, 4, 4]
    assert rows(run("louvain_cross_edges").select("id", "pair_count")) == [("imports|a1|ext:lib", 1)]
    assert rows(run("louvain_surprises").select("id")) == [("imports|a1|ext:lib",)]
    assert {r.label for r in run("louvain_labels").collect()} == {"Functions", "ExternalDependencys"}
    assert any(r.question.startswith("What connects") for r in run("louvain_questions").collect())
    assert {r.id: r.weight for r in run("louvain_expand").where("hop = 1").collect()} == {"a2": 4, "a3": 4, "a4": 4, "ext:lib": 1}


def test_parallel_moves_find_the_cliques(spark):
    g = G(spark, *cliques([("bridge", "a1", "b1")]))
    m = analytics.communities(g, kernel_pairs=1)
    assert {r.id[0]: r.community for r in m.collect()} == {"a": 0, "b": 1}


def test_kernel_is_independent_of_row_order():
    rnd = random.Random(3)
    p = pd.DataFrame([(f"n{a}", f"n{b}", rnd.randint(1, 3)) for a, b in itertools.combinations(range(12), 2) if rnd.random() < 0.3], columns=["a", "b", "weight"])
    assert analytics.louvain_kernel(p) == analytics.louvain_kernel(p.sample(frac=1, random_state=1))


def test_column_functions(spark):
    df = spark.createDataFrame([("", "é", "abc", None, "internal/server/api.go", '{"degree": 3.0, "god_node": true, "community": 7}', "HTTPServer", "UserID")], "a string, b string, c string, d string, p string, bag string, s string, u string")
    r = df.select(
        X.estimate_tokens("a"), X.estimate_tokens("b"), X.estimate_tokens("c"), X.estimate_tokens("d"), X.path_tokens("p"), X.degree("bag"), X.is_hub("bag"), X.community("bag"), X.community("d"), X.snake_case("s"), X.snake_case("u"),
        X.join_path(F.lit("/api/users"), F.lit("/{id}")), X.join_path(F.lit(""), F.lit("")), X.join_path(F.lit("/a/"), F.lit("b")), X.join_route(F.lit("users"), F.lit(":id")), X.human_size(F.lit(2048)), X.project_key(F.lit("/x")), X.source_lines(F.lit("a\nb\nc"), F.lit(2), F.lit(3)),
        X.function_id(F.lit("p"), F.lit("f"), F.lit("")), X.edge_weight(F.lit("injected")), X.confidence(F.lit("routed"), F.lit("")),
    ).first()
    assert list(r) == [0, 1, 2, 0, ["server"], 3, True, 7, -1, "http_server", "user_id", "/api/users/{id}", "/", "/a/b", "users/:id", "2.0 KiB", __import__("hashlib").sha256(b"/x").hexdigest()[:16], "b\nc", "p.f()", 1, "INFERRED"]
    words = spark.createDataFrame([("category",), ("day",), ("address",), ("box",)], "w string").select(X.plural("w").alias("p"))
    assert [x.p for x in words.collect()] == ["categories", "days", "addresses", "boxes"]


def test_search_resolve_and_budget(spark):
    nodes = [*CHAIN_N, N("demo.a_b()", sig="a b b"), N("demo.F", "Field", sig="a a a"), N("x.Y", "Struct", "dir/y.go", '{"package":"demo","name":"Y"}')]
    g = G(spark, nodes, CHAIN_E)
    s = spark.createDataFrame([("r", "demo.B()", "node", "h", "Parses the budget rows", None, 0), ("r", "demo.C()", "node", "h", None, None, 0)], SUMMARIES)
    assert rows(search.search(g.nodes, s, "a a b", 5).select("id", "score")) == [("demo.A()", 4), ("demo.a_b()", 4)]
    assert search.search(g.nodes, s, "", 5).count() == 0 and search.search(g.nodes, s, "a", 0).count() == 0
    hit = lambda t: rows(search.resolve(g.nodes, s, t).select("id", "how"))
    assert hit("demo.B()") == [("demo.B()", "id")] and hit("A") == [("demo.A()", "name")] and hit("y.go") == [("pkg:demo", "package")] and hit("budget") == [("demo.B()", "search")] and hit("nothing at all") == []
    found = traversal.expand(g, one(spark, "demo.A()"), 2)
    lines = rendering.related_lines(g, found, s)
    assert [r.line for r in lines.orderBy("hop").collect()] == ["- [hop 1] demo.A() --calls(EXTRACTED)--> demo.B() (Function): Parses the budget rows\n", "- [hop 2] demo.B() --calls(EXTRACTED)--> demo.C() (Function): (no summary yet)\n"]
    assert rendering.within_budget(lines, 1).count() == 1 and rendering.within_budget(lines, 10_000).count() == 2
    t = rendering.Teller(g, s)
    text = t.context("r", "A", 2, 3000)
    assert text.startswith("# demo.A() (Function)\nSignature: func A()\nSummary: (no summary yet)\nDirect relations:\n  calls: demo.B()(EXTRACTED)\n") and "Related nodes:" in text
    assert "omitted" in t.context("r", "A", 2, 1)
    assert t.query("r", "budget").startswith("Query: budget") and "## Related Nodes" in t.prompt("r", "demo.A()") and "demo.C()" in t.explain("r", "demo.A()", 2)
    with pytest.raises(KeyError):
        t.query("r", "zzz")


def test_upserts(spark):
    old = spark.createDataFrame([N("a", hash="1", at=5, props="{}"), N("b", hash="1", at=5), N("c", hash="1", at=5)], NODES)
    new = spark.createDataFrame([N("a", hash="1", at=9, props='{"x":1}', lines=(3, 4)), N("b", hash="2", at=9), N("d", hash="1", at=9)], NODES)
    assert rows(upserts.gate_nodes(old, new).select("id", "state")) == [("a", "unchanged"), ("b", "written"), ("c", "kept"), ("d", "written")]
    out = {r.id: (r.hash, r.updated_at, r.line_start) for r in upserts.upsert_nodes(old, new, 7).collect()}
    assert out == {"a": ("1", 5, None), "b": ("2", 7, None), "c": ("1", 5, None), "d": ("1", 7, None)}
    assert {r.id: r.properties for r in upserts.refresh_properties(old, new).collect()}["a"] == '{"x":1}'
    e1 = spark.createDataFrame([E("calls", "a", "b", conf=None, props='{"b":1, "a":2}'), E("calls", "a", "c", props=None)], EDGES)
    e2 = spark.createDataFrame([E("calls", "a", "b", props='{"a":2,"b":1}'), E("calls", "a", "c", conf="INFERRED", props="null")], EDGES)
    assert rows(upserts.gate_edges(e1, e2).select("id", "state")) == [("calls|a|b", "unchanged"), ("calls|a|c", "written")]
    s = spark.createDataFrame([("r", "a", "node", "1", "s", "m", 0), ("r", "f.go", "file", "1", "s", "m", 0), ("r", "a", "module", "1", "s", "m", 0)], SUMMARIES)
    n = spark.createDataFrame([N("a", file="f.go"), N("b")], NODES)
    kept = upserts.delete_files(n, e1, s, spark.createDataFrame([("r", "f.go")], "repo_path string, file string"))
    assert [rows(kept[0].select("id")), kept[1].count(), rows(kept[2].select("node_id"))] == [[("b",)], 0, [("f.go",)]]
    marked = upserts.mark_stale(s, spark.createDataFrame([("r", "a"), ("r", "zz")], "repo_path string, id string"))
    assert rows(marked.where("stale = 1").select("level")) == [("node",)]
    fresh = upserts.upsert_summaries(marked, spark.createDataFrame([("r", "a", "node", "2", "n", "m")], "repo_path string, node_id string, level string, hash string, summary string, model string"))
    assert {(r.node_id, r.level): (r.hash, r.stale) for r in fresh.collect()}["a", "node"] == ("2", 0) and fresh.count() == 3


def test_summary_levels(spark):
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    n = spark.createDataFrame([N("d.Foo()", file="f.go", hash="1", props='{"package":"d"}'), N("d.Bar()", file="f.go", hash="2", props='{"package":"d"}'), N("d.Baz()", file="g.go", hash="3", props='{"package":"d"}')], NODES)
    base = [("r", "d.Foo()", "node", "1", "s", None, 1), ("r", "d.Bar()", "node", "2", "s", None, 0), ("r", "d.Baz()", "node", "old", "s", None, 0)]
    s = spark.createDataFrame(base, SUMMARIES)
    assert rows(summaries.pending("node", n, s).select("id")) == [("d.Baz()",), ("d.Foo()",)]
    want = sha("d.Bar():2|d.Foo():1")
    assert rows(summaries.pending("file", n, s).select("id", "hash")) == [("f.go", want)]
    done = spark.createDataFrame([*base, ("r", "f.go", "file", want, "s", None, 0), ("r", "g.go", "file", "any", "s", None, 0)], SUMMARIES)
    assert summaries.pending("file", n, done).count() == 0
    assert rows(summaries.pending("module", n, done).select("id", "hash")) == [("pkg:d", sha(f"f.go:{want}|g.go:any"))]
    with pytest.raises(ValueError):
        summaries.pending("x", n, s)
    entries = spark.createDataFrame([("r", "d.Foo()", "1", "t"), ("r", "d.Baz()", "old", "t"), ("r", "zz", "1", "t")], "repo_path string, id string, hash string, summary string")
    got = {r.id: r.outcome for r in summaries.apply_summaries("node", entries, n, s).collect()}
    assert got == {"d.Foo()": "applied", "d.Baz()": "hash mismatch (code changed since export)", "zz": "unknown id"}
    again = spark.createDataFrame([("r", "f.go", want, "t")], "repo_path string, id string, hash string, summary string")
    assert summaries.apply_summaries("file", again, n, done).first().outcome == "unknown id"


def test_invalidation(spark):
    old = G(spark, [N("a", hash="1"), N("b", hash="1", file="f.go"), N("c"), N("d")], [E("calls", "a", "b"), E("calls", "c", "b"), E("calls", "d", "d")])
    new = spark.createDataFrame([N("a", hash="2"), N("e")], NODES)
    out = summaries.invalidation_targets(old, new, spark.createDataFrame([("r", "f.go")], "repo_path string, file string"))
    assert rows(out.select("id")) == [("a",), ("b",), ("c",), ("e",)]


def test_source_texts(spark):
    g = G(
        spark,
        [N("table:o", "Table"), N("table:o.id", "Column", props='{"sql_type":"INT"}'), N("table:x", "Table"), N("endpoint:GET /a", "Endpoint"), N("f()"), N("ext:lib", "ExternalDependency", props='{"version":">=2"}'), N("enum:p.E", "Enum", sig="enum E")],
        [E("has_field", "table:o", "table:o.id"), E("references_fk", "table:x", "table:o"), E("routed", "f()", "endpoint:GET /a")],
    )
    got = {r.id: r.source for r in summaries.source_text(g).collect()}
    assert got == {"table:o": "Table o\nColumns:\n- id INT\nReferenced by: table:x", "table:x": "Table x", "endpoint:GET /a": "Endpoint GET /a\nHandler: f()", "ext:lib": "External dependency lib@>=2", "enum:p.E": "Enum enum E"}


def test_nearest_entity_across_blocks(spark):
    rnd = random.Random(7)
    ent = [N(f"e{k}", file=rnd.choice("fg"), lines=(rnd.choice([1, 5, 4095, 4096, 9000, rnd.randrange(20_000)]), None)) for k in range(60)]
    com = [N(f"c{k}", file=rnd.choice("fgh"), lines=(None, rnd.choice([5, 4096, rnd.randrange(22_000)]))) for k in range(120)]
    want = []
    for c in com:
        mine = [(e[4], e[1]) for e in ent if e[3] == c[3]]
        if mine:
            want.append((c[1], min([x for x in mine if x[0] >= c[5]], default=max(mine))[1]))
    got = enrich.nearest_entity(spark.createDataFrame(com, NODES), spark.createDataFrame(ent, NODES))
    assert rows(got.select("id", "entity")) == sorted(want, key=str)


def test_rank_within(spark):
    from codeweft.runtime import rank_within

    df = spark.createDataFrame([("a" if k % 3 else None, k * 37 % 101) for k in range(100)], "g string, v int")
    got = {r.v: r.n for r in rank_within(df, ["g"], [F.desc("v")], "n").where("g = 'a'").collect()}
    assert got == {v: n for n, v in enumerate(sorted((k * 37 % 101 for k in range(100) if k % 3), reverse=True), 1)}


def test_nearest_entity_and_rationale(spark):
    c = spark.createDataFrame([N("k1", "Rationale", "f", lines=(1, 2)), N("k2", "Rationale", "f", lines=(9, 9)), N("k3", "Rationale", "empty", lines=(1, 1)), N("k4", "Rationale", "f", lines=(5, 5))], NODES)
    e = spark.createDataFrame([N("a", file="f", lines=(5, 6)), N("b", file="f", lines=(3, 3)), N("c", file="f", lines=(5, 8)), N("d", file=None)], NODES)
    assert rows(enrich.nearest_entity(c, e).select("id", "entity")) == [("k1", "b"), ("k2", "c"), ("k4", "a")]
    go = "// NOTE: first\n// goes on\n//\n// TODO: second\n// WHY:\nx()\n// Foo does\n// things.\nfunc Foo() {}\n// HACK: only\nfunc Bar() {}\n"
    assert enrich.rationale_of("a.go", go) == [(1, 2, "NOTE", "first goes on"), (4, 4, "TODO", "second"), (10, 10, "HACK", "only"), (7, 8, "DOCSTRING", "Foo does things.")]
    py = '# FIXME: this\ndef f():\n\n    """Does\n    it."""\nclass A:\n    pass\n'
    assert enrich.rationale_of("a.py", py) == [(1, 1, "FIXME", "this"), (4, 5, "DOCSTRING", "Does     it.")]
    ts = "/**\n * Makes it.\n */\nexport function f() {}\n/** stray */\nx = 1\n"
    assert enrich.rationale_of("a.ts", ts) == [(1, 3, "DOCSTRING", "Makes it.")]
    files = spark.createDataFrame([("r", "a.go", go), ("r", "a.go", go), ("r", "n.go", None)], "repo_path string, file string, content string")
    assert enrich.extract_rationale(files).count() == 4
