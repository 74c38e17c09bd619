"""graph.json, graph.html and GRAPH_REPORT.md."""

from __future__ import annotations

import html
import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft import model
from codeweft.functions import columns as X
from codeweft.operators import analytics
from codeweft.operators.graph import R, PropertyGraph, degrees, lookup
from codeweft.operators.rendering import rationale


def export_nodes(g: PropertyGraph, summaries: DataFrame) -> DataFrame:
    """Nodes with their summary and the rationale that explains them, ordered by kind and text."""
    why = rationale(g).groupBy(R, "target").agg(F.array_sort(F.collect_list(F.struct("kind", "text"))).alias("rationale"))
    n = lookup(g.nodes, summaries.where("level = 'node'"), {R: R, "id": "node_id"}, {"summary": "summary"})
    return lookup(n, why, {R: R, "id": "target"}, {"rationale": "rationale"})


def rationale_counts(g: PropertyGraph) -> DataFrame:
    return rationale(g).groupBy(R, "target").agg(F.count(F.lit(1)).alias("n_rationale"), F.min(F.struct("kind", "text")).alias("v")).select(R, "target", "n_rationale", F.col("v.kind").alias("first_kind"))


def metadata(g: PropertyGraph) -> DataFrame:
    """Per checkout: counts and the languages of its nodes."""
    n = g.nodes.groupBy(R).agg(F.count(F.lit(1)).alias("node_count"), F.array_join(F.array_sort(F.collect_set(F.nullif(X.text_prop("properties", "language"), F.lit("")))), ",").alias("languages"))
    e = g.edges.groupBy(R).agg(F.count(F.lit(1)).alias("edge_count"))
    return lookup(n, e, {R: R}, {"edge_count": "edge_count"}).fillna(0, ["edge_count"])


def graph_json(g: PropertyGraph, summaries: DataFrame, repo: str, members: DataFrame, hubs: DataFrame, built_at: int | None = None) -> dict:
    """One checkout as a document; rows are streamed to the driver in id order. Empty graphs have empty lists."""
    mine = PropertyGraph(g.nodes.where(F.col(R) == repo), g.edges.where(F.col(R) == repo))
    nodes = [
        {"id": r.id, "type": r.type, "file": r.file, "line_start": r.line_start, "line_end": r.line_end, "signature": r.signature, "hash": r.hash, "properties": json.loads(r.properties or "null"), "summary": r.summary, "rationale": [x.asDict() for x in r.rationale or []]}
        for r in export_nodes(mine, summaries.where(F.col(R) == repo)).orderBy("id").toLocalIterator()
    ]
    edges = [{"id": r.id, "type": r.type, "src": r.src_id, "dst": r.dst_id, "confidence": r.confidence} for r in mine.edges.orderBy("id").toLocalIterator()]
    m = members.where(F.col(R) == repo)
    label = {r.community: r.label for r in analytics.labels(mine.nodes, m).toLocalIterator()}
    groups: dict[int, list[str]] = {}
    for r in m.orderBy("community", "id").toLocalIterator():
        groups.setdefault(r.community, []).append(r.id)
    langs = sorted({(n["properties"] or {}).get("language") for n in nodes} - {None, ""})
    meta = {"repo_path": repo, "node_count": len(nodes), "edge_count": len(edges)} | ({"languages": langs} if langs else {})
    if built_at is not None:
        meta["built_at"] = datetime.fromtimestamp(built_at, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {
        "nodes": nodes, "edges": edges, "node_count": len(nodes), "edge_count": len(edges), "communities": [{"id": c, "label": label.get(c, ""), "node_ids": ids} for c, ids in sorted(groups.items())],
        "god_nodes": [r.id for r in hubs.where(F.col(R) == repo).orderBy("rank").toLocalIterator()], "metadata": meta,
    }


def report(g: PropertyGraph, repo: str, members: DataFrame, hubs: DataFrame) -> str:
    """Hubs, communities, surprising connections and questions as Markdown."""
    mine = PropertyGraph(g.nodes.where(F.col(R) == repo), g.edges.where(F.col(R) == repo))
    m = members.where(F.col(R) == repo)
    label = analytics.labels(mine.nodes, m)
    names = {r.community: (r.label, r.n_members) for r in label.toLocalIterator()}
    out = ["# Graph Report", "", "## God Nodes", ""]
    out += [f"- `{r.id}` (degree {r.degree})" for r in hubs.where(F.col(R) == repo).orderBy("rank").limit(model.REPORT_HUBS).collect()] or ["No god nodes flagged."]
    out += ["", "## Communities", ""]
    out += [f"- {c}: {n} ({k} node(s))" for c, (n, k) in sorted(names.items())] or ["No communities assigned."]
    out += ["", "## Surprising Connections", ""]
    crossing = analytics.surprises(mine, m).orderBy("rank").collect()
    out += [f"- `{r.src_id}` --{r.type}({r.confidence})--> `{r.dst_id}` ({names[r.src_community][0]} -> {names[r.dst_community][0]}, {r.pair_count} edge(s) total between these communities)" for r in crossing] or ["No cross-community edges found."]
    out += ["", "## Suggested Questions", ""]
    out += [f"- {r.question}" for r in analytics.questions(mine, m, label, degrees(mine)).orderBy("rank").collect()]
    return "\n".join(out) + "\n"


PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:0;display:flex}}canvas{{flex:1}}aside{{width:22em;padding:1em;overflow:auto;height:100vh;box-sizing:border-box}}</style></head>
<body><canvas id="c" width="1100" height="900"></canvas><aside><h1>{title}</h1><input id="q" placeholder="search"><ul id="l"></ul></aside>
<script id="data" type="application/json">{data}</script>
<script>
const g=JSON.parse(document.getElementById('data').textContent),c=document.getElementById('c').getContext('2d');
const shown=g.nodes.filter(n=>n.type!=='Field'&&n.type!=='Column'),at={{}};
shown.forEach((n,i)=>{{const a=2.399963*i,r=14*Math.sqrt(i);at[n.id]=[550+r*Math.cos(a),450+r*Math.sin(a)]}});
function draw(hit){{c.clearRect(0,0,1100,900);c.strokeStyle='#ccc';g.edges.forEach(e=>{{const a=at[e.src],b=at[e.dst];if(a&&b){{c.beginPath();c.moveTo(...a);c.lineTo(...b);c.stroke()}}}});
shown.forEach(n=>{{c.fillStyle=hit&&hit.has(n.id)?'#c33':'#369';c.fillRect(at[n.id][0]-3,at[n.id][1]-3,6,6)}})}}
document.getElementById('q').oninput=e=>{{const t=e.target.value.toLowerCase().split(/[^a-z0-9]+/).filter(Boolean),f=shown.filter(n=>t.length&&t.every(w=>(n.id+' '+(n.signature||'')+' '+(n.summary||'')).toLowerCase().includes(w)));
document.getElementById('l').replaceChildren(...f.slice(0,40).map(n=>{{const x=document.createElement('li');x.textContent=n.type+' '+n.id;return x}}));draw(new Set(f.map(n=>n.id)))}};draw();
</script></body></html>
"""


def graph_html(document: dict) -> str:
    """A page of its own with the document inside; markup in the data can't end the script element."""
    data = json.dumps(document, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    return PAGE.format(title=html.escape(document["metadata"]["repo_path"]), data=data)


def write_all(folder: str, document: dict, text: str) -> list[str]:
    os.makedirs(folder, exist_ok=True)
    files = {"graph.json": json.dumps(document, indent=2, ensure_ascii=False), "graph.html": graph_html(document), "GRAPH_REPORT.md": text}
    for name, body in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(body)
    return sorted(files)

