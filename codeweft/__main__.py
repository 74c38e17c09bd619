"""Command line: python -m codeweft COMMAND. One session, one store root."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeweft import model
from codeweft.operators import analytics, graph, search, summaries, traversal, upserts
from codeweft.operators.graph import R
from codeweft.operators.rendering import Teller
from codeweft.plans import api as serving
from codeweft.plans import export, store
from codeweft.sources import scan
from codeweft.sources.graph_tables import one_summary


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeweft")
    p.add_argument("--repo", default=".")
    p.add_argument("--root", default=os.path.expanduser("~/.cache/codeweft"), help="folder of the stores")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, (kind, default) in options.items():
            c.add_argument("--" + k.replace("_", "-"), **({"action": "store_true"} if kind is bool else {"type": kind, "default": default}))
        return c

    add("build", no_analyze=(bool, False), god_nodes=(int, model.HUBS))
    add("update")
    add("context", "target", hops=(int, model.HOPS), max_tokens=(int, model.MAX_TOKENS))
    add("search", "q", top=(int, 10))
    add("query", "q", hops=(int, model.HOPS), max_tokens=(int, model.MAX_TOKENS))
    add("path", "a", "b")
    add("explain", "node", hops=(int, 1))
    add("prompt", "node", max_tokens=(int, model.MAX_TOKENS))
    add("analyze", recluster=(bool, False), resolution=(float, model.RESOLUTION), god_nodes=(int, model.HUBS))
    add("export", output=(str, "codeweft-out"))
    add("report", output=(str, "codeweft-out"))
    add("pending", level=(str, "node"), limit=(int, 0))
    add("apply", "file", level=(str, "node"), model=(str, "provider"))
    add("serve", host=(str, "localhost"), port=(int, 7465), api_key=(str, None))
    add("tools")
    add("projects")
    add("prune", dry_run=(bool, False), yes=(bool, False))
    return p


def run(args: argparse.Namespace, spark: SparkSession, out=sys.stdout) -> int:
    repo = os.path.abspath(args.repo)
    say = lambda *x: print(*x, file=out)
    if args.command == "projects":
        for x in serving.Hub(spark, args.root).projects():
            say(f"{x['key']}  {x['status']:<12} {x['freshness']:<8} {x['n_nodes']:>8} nodes {x['n_edges']:>8} edges  {x['repo_path'] or '-'}")
        return 0
    if args.command == "prune":
        gone = store.prune_candidates(store.discover(spark, args.root))
        for x in gone:
            say(("would remove " if args.dry_run or not args.yes else "removed ") + f"{x['key']} {x['repo_path'] or ''} {x['bytes']} bytes")
            if args.yes and not args.dry_run:
                store.remove(args.root, x["key"])
        return 0
    if args.command == "serve":
        hub = serving.Hub(spark, args.root)
        server = serving.make_server(hub, args.host, args.port, args.api_key)
        try:
            server.serve_forever()
        finally:
            hub.close()
        return 0
    s = store.Store(spark, store.store_folder(args.root, repo))
    if args.command == "build":
        say(json.dumps(store.build(s, repo, analyze=not args.no_analyze, hubs=args.god_nodes)))
        return 0
    if args.command == "update":
        say(json.dumps(store.update(s, repo)))
        return 0
    g = s.graph()
    g = graph.PropertyGraph(g.nodes.where(F.col(R) == repo), g.edges.where(F.col(R) == repo))
    told = one_summary(s.table("summaries"))
    teller = Teller(g, told)
    try:
        if args.command == "context":
            say(teller.context(repo, args.target, args.hops, args.max_tokens))
        elif args.command == "search":
            for r in graph.lookup(search.search(g.nodes, told, args.q, args.top), g.nodes, {R: R, "id": "id"}, {"type": "type"}).orderBy("rank").collect():
                say(f"{r.score:<6d} {r.type:<20} {r.id}")
        elif args.command == "query":
            say(teller.query(repo, args.q, args.hops, args.max_tokens))
        elif args.command == "path":
            rows = traversal.paths(g, spark.createDataFrame([(repo, args.a, args.b)], f"{R} string, src string, dst string")).orderBy("hop_no").collect()
            for r in rows:
                say(r.id if not r.via_edge else f"  --{r.via_edge}({r.confidence or '?'})--> {r.id}")
            if not rows:
                say("no path found")
        elif args.command == "explain":
            say(teller.explain(repo, args.node, args.hops))
        elif args.command == "prompt":
            say(teller.prompt(repo, args.node, args.max_tokens))
        elif args.command == "analyze":
            s.commit({"nodes": s.table("nodes").where(F.col(R) != repo).unionByName(store.analyse(g, args.god_nodes, args.resolution))})
            say("analysed")
        elif args.command in ("export", "report"):
            m, hubs = analytics.communities(g), graph.hubs(graph.degrees(g))
            text = export.report(g, repo, m, hubs)
            if args.command == "report":
                os.makedirs(args.output, exist_ok=True)
                with open(os.path.join(args.output, "GRAPH_REPORT.md"), "w") as f:
                    f.write(text)
            else:
                export.write_all(args.output, export.graph_json(g, told, repo, m, hubs, s.last_build_at(repo)), text)
            say(args.output)
        elif args.command == "pending":
            df = summaries.pending(args.level, g.nodes, told).orderBy("id")
            for line in (df.limit(args.limit) if args.limit > 0 else df).toJSON().toLocalIterator():
                say(line)
        elif args.command == "apply":
            rows = scan.read_applied(spark, args.file).withColumn(R, F.lit(repo))
            done = summaries.apply_summaries(args.level, rows, g.nodes, told)
            new = done.where("outcome = 'applied'").select(R, F.col("id").alias("node_id"), F.lit(args.level).alias("level"), "hash", "summary", F.lit(args.model).alias("model"))
            outcome = {r.outcome: r["count"] for r in done.groupBy("outcome").count().collect()}
            s.commit({"summaries": upserts.upsert_summaries(s.table("summaries"), new)})
            say(json.dumps(outcome))
        elif args.command == "tools":
            serving.serve_stdio(serving.Api(serving.GraphService(spark, s.folder), repo), sys.stdin, out)
    except KeyError as e:
        print(f"error: {e.args[0]}", file=sys.stderr)
        return 1
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("codeweft").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
