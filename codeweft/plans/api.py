"""JSON answers over a graph service, an HTTP server for them, and the tools other programs call."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeweft import model
from codeweft.operators import graph, rendering, search, traversal
from codeweft.operators.graph import R, PropertyGraph
from codeweft.plans import store as stores
from codeweft.streaming.refresh import GraphService


def clamp(value, default: int, most: int) -> int:
    """Missing, malformed and non-positive values give the default, larger ones the maximum."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return default
    return default if n <= 0 else min(n, most)


class NotFound(Exception):
    pass


class Api:
    """Answers about one checkout of a store."""

    def __init__(self, service: GraphService, repo: str) -> None:
        self.service, self.repo = service, repo

    @property
    def g(self) -> PropertyGraph:
        s = self.service.snapshot.graph
        return PropertyGraph(s.nodes.where(F.col(R) == self.repo), s.edges.where(F.col(R) == self.repo))

    @property
    def summaries(self):
        return self.service.snapshot.summaries.where(F.col(R) == self.repo)

    def _teller(self) -> rendering.Teller:
        return rendering.Teller(self.g, self.summaries)

    def _there(self, id: str):
        n = self.g.nodes.where(F.col("id") == id).first()
        if n is None:
            raise NotFound(id)
        return n

    @staticmethod
    def _node(r) -> dict:
        return {"id": r.id, "type": r.type, "file": r.file, "line_start": r.line_start, "line_end": r.line_end, "signature": r.signature, "degree": r.degree, "properties": json.loads(r.properties or "null")}

    def _document(self, g: PropertyGraph) -> dict:
        n = graph.lookup(g.nodes, graph.degrees(g), {R: R, "id": "id"}, {"degree": "degree"})
        return {
            "nodes": [self._node(r) for r in n.orderBy("id").toLocalIterator()],
            "edges": [{"id": r.id, "type": r.type, "src": r.src_id, "dst": r.dst_id, "confidence": r.confidence} for r in g.edges.orderBy("src_id", "dst_id", "id").toLocalIterator()],
        }

    def graph(self, types: str = "") -> dict:
        return self._document(graph.visible(self.g, [t for t in types.split(",") if t] or None))

    def local(self, id: str, hops=None) -> dict:
        self._there(id)
        g = self.g
        target = g.nodes.where(F.col("id") == id).select(R, F.col("id").alias("target"))
        found = traversal.levels(g, target, clamp(hops, model.HOPS, model.MOST_HOPS)).select(R, "id")
        return self._document(PropertyGraph(graph.semi(g.nodes, found, {R: R, "id": "id"}), g.induced(found)))

    def node(self, id: str) -> dict:
        n = self._there(id)
        notes = {(r.node_id, r.level): r for r in self.summaries.where(F.col("node_id").isin([id, n.file or ""])).collect()}

        def note(key, hash):
            r = notes.get(key)
            return {"state": "none"} if r is None else {"state": "current" if not r.stale and (hash is None or r.hash == hash) else "stale", "text": r.summary, "model": r.model}

        rel = rendering.relations(self.g, self.g.nodes.where(F.col("id") == id).select(R, F.col("id").alias("target")))
        out = {
            "id": id, "type": n.type, "file": n.file, "line_start": n.line_start, "line_end": n.line_end, "signature": n.signature, "note": note((id, "node"), n.hash),
            "relations": [{"edge_type": r.type, "node_id": r.other, "direction": r.direction, "confidence": r.confidence} for r in rel.orderBy("type", "other").toLocalIterator()],
        }
        if n.type in ("Struct", "Interface", "Function"):
            out["file_note"] = note((n.file or "", "file"), None)
        return out

    def search(self, q: str, top=None) -> list[dict]:
        hits = search.search(self.g.nodes, self.summaries, q, clamp(top, 10, model.MOST_TOP))
        return [{"id": r.id, "score": r.score} for r in hits.orderBy("rank").collect()]

    def query(self, q: str, hops=None, max_tokens=None) -> dict:
        if not q:
            raise ValueError("q is missing")
        try:
            return {"text": self._teller().query(self.repo, q, clamp(hops, model.HOPS, model.MOST_HOPS), clamp(max_tokens, model.MAX_TOKENS, model.MOST_TOKENS))}
        except KeyError as e:
            raise NotFound(str(e)) from e

    def path(self, src: str, dst: str) -> dict:
        pairs = self.g.nodes.sparkSession.createDataFrame([(self.repo, src, dst)], f"{R} string, src string, dst string")
        rows = traversal.paths(self.g, pairs).orderBy("hop_no").collect()
        return {"found": bool(rows), "hops": [{"id": r.id, "via_edge": r.via_edge, "confidence": r.confidence, "cost": r.cost} for r in rows]}

    def explain(self, id: str, hops=None) -> dict:
        self._there(id)
        return {"text": self._teller().explain(self.repo, id, clamp(hops, 1, model.MOST_HOPS))}

    def god_nodes(self, n=None) -> list[dict]:
        return [{"id": r.id, "degree": r.degree} for r in graph.hubs(graph.degrees(self.g), clamp(n, model.HUBS, model.MOST_TOP)).orderBy("rank").collect()]

    def call(self, name: str, args: dict[str, str]):
        """Route of the HTTP server and the tools."""
        ways = {
            "graph": lambda: self.graph(args.get("types", "")), "graph/local": lambda: self.local(args.get("id", ""), args.get("hops")), "node": lambda: self.node(args.get("id", "")),
            "search": lambda: self.search(args.get("q", ""), args.get("topK")), "query": lambda: self.query(args.get("q", ""), args.get("hops"), args.get("max_tokens")),
            "path": lambda: self.path(args.get("src", ""), args.get("dst", "")), "explain": lambda: self.explain(args.get("id", ""), args.get("hops")), "god-nodes": lambda: self.god_nodes(args.get("n")),
        }
        if name not in ways:
            raise NotFound(name)
        return ways[name]()


class Hub:
    """Stores below a folder, each opened when first asked for."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._open, self.closed = spark, root, {}, False

    def projects(self) -> list[dict]:
        return sorted(stores.discover(self.spark, self.root), key=lambda x: ((x["repo_path"] or "").rstrip("/").rsplit("/", 1)[-1], x["repo_path"] or "", x["key"]))

    def api(self, key: str) -> Api:
        if self.closed:
            raise RuntimeError("closed")
        if key not in self._open:
            found = next((x for x in stores.discover(self.spark, self.root) if x["key"] == key), None)
            if found is None:
                raise NotFound(key)
            if found["status"] != "built":
                raise RuntimeError(f"{key} is {found['status']}")
            self._open[key] = Api(GraphService(self.spark, found["folder"]), found["repo_path"])
        return self._open[key]

    def close(self) -> None:
        self.closed = True
        self._open.clear()


TOOLS = {
    "query_graph": ("query", ["q", "hops", "max_tokens"]), "get_node": ("node", ["id"]), "shortest_path": ("path", ["src", "dst"]), "export_graph": ("graph", ["types"]),
}


def call_tool(api: Api, name: str, args: dict) -> dict:
    """One tool call; failures come back as a message, not as an exception."""
    if name not in TOOLS:
        return {"error": f"unknown tool {name!r}"}
    route, known = TOOLS[name]
    try:
        return {"result": api.call(route, {k: str(v) for k, v in args.items() if k in known})}
    except Exception as e:
        return {"error": str(e)}


def serve_stdio(api: Api, lines, out) -> None:
    """JSON-RPC over lines: initialize, tools/list, tools/call."""
    for line in lines:
        if not line.strip():
            continue
        try:
            m = json.loads(line)
        except ValueError:
            out.write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}) + "\n")
            continue
        method, result = m.get("method"), None
        if method == "initialize":
            result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "codeweft", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {p: {"type": "string"} for p in ps}}} for n, (_, ps) in TOOLS.items()]}
        elif method == "tools/call":
            r = call_tool(api, m.get("params", {}).get("name", ""), m.get("params", {}).get("arguments", {}))
            result = {"content": [{"type": "text", "text": json.dumps(r.get("result", r.get("error")))}], "isError": "error" in r}
        if "id" in m:
            body = {"result": result} if result is not None else {"error": {"code": -32601, "message": "method not found"}}
            out.write(json.dumps({"jsonrpc": "2.0", "id": m["id"], **body}) + "\n")
        out.flush()


def make_server(hub: Hub, host: str = "localhost", port: int = 7465, api_key: str | None = None) -> ThreadingHTTPServer:
    """GET /api/projects, /api/<key>/<route>, /api/<key>/events (server-sent); a failing request never stops the server."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _send(self, code: int, body) -> None:
            raw = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _events(self, api: Api) -> None:
            e = api.service.events.subscribe()
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            try:
                while not hub.closed:
                    if e.wait(15):
                        e.clear()
                        self.wfile.write(b"event: refresh\ndata: {}\n\n")
                    else:
                        self.wfile.write(b": ping\n\n")
                    self.wfile.flush()
            except OSError:
                pass
            finally:
                api.service.events.unsubscribe(e)

        def do_GET(self):
            if api_key and self.headers.get("Authorization") != f"Bearer {api_key}":
                return self._send(401, {"error": "unauthorized"})
            url = urlparse(self.path)
            parts = url.path.strip("/").split("/")
            args = {k: v[0] for k, v in parse_qs(url.query).items()}
            try:
                if parts == ["api", "projects"]:
                    return self._send(200, hub.projects())
                if len(parts) < 3 or parts[0] != "api":
                    raise NotFound(url.path)
                api = hub.api(parts[1])
                if parts[2] == "events":
                    return self._events(api)
                return self._send(200, api.call("/".join(parts[2:]), args))
            except NotFound as e:
                return self._send(404, {"error": f"not found: {e}"})
            except ValueError as e:
                return self._send(400, {"error": str(e)})
            except RuntimeError as e:
                return self._send(503 if hub.closed else 500, {"error": str(e)})
            except Exception as e:
                return self._send(500, {"error": str(e)[:300]})

    return ThreadingHTTPServer((host, port), Handler)
