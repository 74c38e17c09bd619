"""A store on a throwaway git repository: build, update, summaries, exports, service, command line; streams; the driver's contract."""

import argparse
import io
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codeweft import __main__ as cli
from codeweft.model import EDGES
from codeweft.plans import api as serving
from codeweft.plans import export, store
from codeweft.sources import scan
from codeweft.streaming import refresh


def git(repo, *args):
    subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_build_update_serve(spark, tmp_path):
    repo, root = str(tmp_path / "repo"), str(tmp_path / "stores")
    os.makedirs(repo + "/pkg")
    write = lambda f, t: open(f"{repo}/{f}", "w").write(t)
    write("go.mod", "module demo\n")
    write("pkg/a.go", "package pkg\n\n// Opens it. It is safe.\nfunc Open() { Close() }\n\nfunc Gone() {}\n")
    write("pkg/b.go", "package pkg\n\n// NOTE: must be last\nfunc Close() {}\n")
    git(repo, "init", "-q")
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", "one")
    run = lambda *a: (lambda out: (cli.run(cli.parser().parse_args(["--repo", repo, "--root", root, *a]), spark, out), out.getvalue()))(io.StringIO())
    assert run("build")[0] == 0
    s = store.Store(spark, store.store_folder(root, repo))
    assert s.last_commit(repo) == scan.head_commit(repo) and scan.freshness(repo, s.last_commit(repo)) == "current"
    ids = lambda: {r.id for r in s.table("nodes").collect()}
    assert {"pkg.Open()", "pkg.Close()", "pkg.Gone()", "pkg:pkg", "rationale:pkg/b.go:3:NOTE"} <= ids()
    edges = {r.id: r.confidence for r in s.table("edges").collect()}
    assert edges["calls|pkg.Open()|pkg.Close()"] == "EXTRACTED" and edges["explains|rationale:pkg/b.go:3:NOTE|pkg.Close()"] == "INFERRED"
    bag = {r.id: json.loads(r.properties) for r in s.table("nodes").where("id like 'pkg.%'").collect()}
    assert bag["pkg.Open()"]["degree"] == 2 and bag["pkg.Open()"]["name"] == "Open" and "community_label" in bag["pkg.Open()"]
    service = serving.GraphService(spark, s.folder)
    assert service.refresh() is False and json.loads(run("update")[1]) == {"no_change": True}

    # summaries: what is pending goes out, what fits comes back in
    pending = [json.loads(x) for x in run("pending")[1].splitlines()]
    assert [p["id"] for p in pending] == ["pkg.Close()", "pkg.Gone()", "pkg.Open()"]
    given = tmp_path / "in.json"
    given.write_text(json.dumps([{"id": p["id"], "hash": p["hash"], "summary": f"Tells of {p['id']}"} for p in pending] + [{"id": "zz", "hash": "", "summary": ""}]))
    assert json.loads(run("apply", str(given))[1]) == {"applied": 3, "unknown id": 1}
    assert run("pending")[1] == ""

    # one file changes: a function goes, another changes; references from the other file stay
    write("pkg/b.go", "package pkg\n\n// NOTE: must be last\nfunc Close() { Open() }\n")
    write("pkg/a.go", "package pkg\n\n// Opens it. It is safe.\nfunc Open() { Close() }\n")
    git(repo, "commit", "-qam", "two")
    told = json.loads(run("update")[1])
    assert told["changed_files"] == 2 and told["invalidated"] >= 3
    assert "pkg.Gone()" not in ids() and {"calls|pkg.Open()|pkg.Close()", "calls|pkg.Close()|pkg.Open()"} <= {r.id for r in s.table("edges").collect()}
    assert {r.node_id: r.stale for r in s.table("summaries").collect()} == {"pkg.Close()": 1, "pkg.Open()": 1}

    # service and answers
    heard = service.events.subscribe()
    assert service.refresh() is True and heard.is_set()
    api = serving.Api(service, repo)
    assert api.path("pkg.Open()", "pkg.Close()")["found"] and not api.path("pkg.Open()", "zz")["found"]
    assert api.node("pkg.Close()")["note"]["state"] == "stale" and api.search("close")[0]["id"] == "pkg.Close()"
    assert {n["id"] for n in api.local("pkg.Open()", 1)["nodes"]} >= {"pkg.Open()", "pkg.Close()"} and "pkg.Close()" in api.explain("pkg.Open()")["text"]
    with pytest.raises(serving.NotFound):
        api.call("node", {"id": "zz"})
    assert serving.call_tool(api, "get_node", {"id": "zz"})["error"] and serving.call_tool(api, "no_tool", {})["error"]
    out = io.StringIO()
    serving.serve_stdio(api, ['{"jsonrpc":"2.0","id":1,"method":"tools/list"}\n', "nonsense\n", '{"jsonrpc":"2.0","id":2,"method":"x"}\n'], out)
    assert [("result" in json.loads(x)) for x in out.getvalue().splitlines()] == [True, False, False]
    assert [serving.clamp(v, 2, 6) for v in (None, "x", -1, 0, "3", 99)] == [2, 2, 2, 2, 3, 6]

    # exports, catalog
    assert run("export", "--output", str(tmp_path / "out"))[0] == 0
    doc = json.loads((tmp_path / "out/graph.json").read_text())
    assert [n["id"] for n in doc["nodes"]] == sorted(n["id"] for n in doc["nodes"]) and doc["metadata"]["languages"] == ["go"] and doc["node_count"] == len(doc["nodes"])
    assert '</script><b>' not in export.graph_html({"nodes": [{"id": "</script><b>"}], "metadata": {"repo_path": "<r>"}})
    assert (tmp_path / "out/GRAPH_REPORT.md").read_text().startswith("# Graph Report\n\n## God Nodes")
    os.makedirs(f"{root}/broken")
    store.Store(spark, f"{root}/empty")
    found = {x["key"]: x["status"] for x in store.discover(spark, root)}
    assert found == {store.key_of(repo): "built", "broken": "unreadable", "empty": "never-built"}
    assert [x["key"] for x in store.prune_candidates(store.discover(spark, root))] == ["empty"]
    for bad in ("..", "a/b", "", "/etc"):
        with pytest.raises(ValueError):
            store.remove(root, bad)
    assert store.remove(root, "empty") and not store.remove(root, "empty")
    hub = serving.Hub(spark, root)
    with pytest.raises(serving.NotFound):
        hub.api("zz")
    assert hub.api(store.key_of(repo)).repo == repo
    with pytest.raises(FileNotFoundError):
        store.StoreReader(spark, str(tmp_path / "none"))
    s.vacuum()
    assert s.table("nodes").count() > 0


def test_language_detection(spark):
    f = spark.createDataFrame([("m", "go.mod"), ("m", "package.json"), ("m", "tsconfig.json"), ("c", "a/x.py"), ("c", "b/y.py"), ("c", "z.go"), ("c", ".h/a.go"), ("c", "vendor/b.go"), ("c", "node_modules/c.go"), ("t", "a.ts"), ("t", "a.go")], "repo_path string, file string")
    got = sorted(tuple(r) for r in scan.detect_languages(f).collect())
    assert got == [("c", "python", 1, "count"), ("m", "go", 1, "marker"), ("m", "typescript", 2, "marker"), ("t", "go", 1, "count")]


def test_streams(spark, tmp_path):
    from datetime import UTC, datetime

    rows = [("r", "calls|a|b", "calls", "a", "b", None, None, datetime(2025, 1, 1, tzinfo=UTC)), ("r", "calls|a|b", "calls", "a", "b", None, None, datetime(2025, 1, 1, tzinfo=UTC)), ("r", "calls|a|c", "calls", "a", "c", None, None, datetime(2025, 6, 1, tzinfo=UTC))]
    spark.createDataFrame(rows, EDGES).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(EDGES).parquet(str(tmp_path / "e"))
    assert {r.id: r.degree for r in refresh.run_once(refresh.stream_degrees(stream())).collect()} == {"a": 2, "b": 1, "c": 1}
    assert sorted(r.n_edges for r in refresh.run_once(refresh.stream_edge_counts(stream())).collect()) == [1, 2]
    for _ in range(2):
        refresh.append_stream(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_contract(spark):
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and {f"p{n}_found" for n in (2, 3, 5, 6)} <= set(q)
    assert __spark_entry__.entry(spark).columns == ["repo_path", "id", "degree", "rank"]
    assert isinstance(cli.parser(), argparse.ArgumentParser)


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found", "p6_found", "god_nodes", "search_topk", "pending_files", "expand_hops"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{d}/{f}'")
    df = __spark_entry__.queries()[name](spark, d)
    cols = sorted(df.columns)
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall(), key=str)
    assert sorted((tuple(r) for r in df.select(*[F.col(c) for c in cols]).collect()), key=str) == want
