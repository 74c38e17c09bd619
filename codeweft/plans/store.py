"""A graph store in a folder of parquet versions, the build and update pipelines over it, and a catalog of stores.

``current.json`` names the version that counts and is replaced in one rename; readers keep the version they opened.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft import model
from codeweft.operators import analytics, enrich, upserts
from codeweft.operators.graph import R, PropertyGraph, degrees, flag_hubs, lookup, semi, with_both_ends
from codeweft.operators.summaries import invalidation_targets
from codeweft.runtime import cut
from codeweft.sources import scan
from codeweft.sources.extract import EXTRACTORS, extract

TABLES = {"nodes": model.NODES, "edges": model.EDGES, "summaries": model.SUMMARIES}
META = f"{R} string, last_commit string, last_build_at bigint, build_no bigint"


class StoreReader:
    """Read-only view of a store; has no way to write. Raises where there is no store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        if not os.path.exists(os.path.join(folder, "current.json")):
            raise FileNotFoundError(f"no store in {folder}")

    def state(self) -> dict:
        with open(os.path.join(self.folder, "current.json")) as f:
            return json.load(f)

    def table(self, name: str) -> DataFrame:
        at = self.state()["tables"].get(name)
        if name not in TABLES:
            raise KeyError(name)
        if at is None:
            return self.spark.createDataFrame([], TABLES[name])
        df = self.spark.read.parquet(os.path.join(self.folder, at))
        return df if name != "edges" or "confidence" in df.columns else df.withColumn("confidence", F.lit(model.EXTRACTED))

    def graph(self) -> PropertyGraph:
        n = self.table("nodes")
        return PropertyGraph(n, with_both_ends(self.table("edges"), n))

    def last_commit(self, repo: str) -> str | None:
        m = self.state()["meta"].get(repo)
        return (m or {}).get("last_commit") or None

    def last_build_at(self, repo: str) -> int | None:
        m = self.state()["meta"].get(repo)
        return m["last_build_at"] if m else None

    def build_no(self) -> int:
        return self.state()["build_no"]


class Store(StoreReader):
    def __init__(self, spark: SparkSession, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        if not os.path.exists(os.path.join(folder, "current.json")):
            self._publish_at(folder, {"tables": {}, "meta": {}, "build_no": 0})
        super().__init__(spark, folder)

    @staticmethod
    def _publish_at(folder: str, state: dict) -> None:
        tmp = os.path.join(folder, f".current-{uuid.uuid4().hex}")
        with open(tmp, "w") as f:
            json.dump(state, f)
        os.replace(tmp, os.path.join(folder, "current.json"))

    def commit(self, tables: dict[str, DataFrame], meta: dict[str, dict] | None = None) -> None:
        """Write new versions of tables and publish them together with the build state."""
        state = self.state()
        for name, df in tables.items():
            at = f"{name}-{uuid.uuid4().hex}"
            df.select(*[f.name for f in TABLES[name].fields]).write.parquet(os.path.join(self.folder, at))
            state["tables"][name] = at
        state["meta"].update(meta or {})
        state["build_no"] += bool(meta)
        self._publish_at(self.folder, state)

    def vacuum(self) -> None:
        """Delete versions that no longer count."""
        keep = set(self.state()["tables"].values()) | {"current.json"}
        for x in os.listdir(self.folder):
            if x not in keep:
                p = os.path.join(self.folder, x)
                shutil.rmtree(p) if os.path.isdir(p) else os.remove(p)


def analyse(g: PropertyGraph, hubs: int = model.HUBS, resolution: float = model.RESOLUTION) -> DataFrame:
    """Nodes with degree, hub flag, community and label in their property bags; other properties stay."""
    d = cut(flag_hubs(degrees(g), hubs))
    m = cut(analytics.communities(g, resolution))
    label = analytics.labels(g.nodes, m)
    n = lookup(lookup(g.nodes, d, {R: R, "id": "id"}, {"_d": "degree", "_h": "god_node"}), m, {R: R, "id": "id"}, {"_c": "community"})
    n = lookup(n, label, {R: R, "_c": "community"}, {"_l": "label"})
    own = ["degree", "god_node", "community", "community_label"]
    rest = F.regexp_replace(F.coalesce(F.nullif(F.trim("properties"), F.lit("null")), F.lit("{}")), r"\}\s*$", "")
    for key in own:  # what an earlier analysis left is replaced
        rest = F.regexp_replace(rest, rf',?\s*"{key}"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[^,}}]*)', "")
    rest = F.regexp_replace(rest, r"^\{\s*,", "{")
    added = F.substr(F.to_json(F.struct(F.col("_d").alias("degree"), F.col("_h").alias("god_node"), F.col("_c").alias("community"), F.col("_l").alias("community_label"))), F.lit(2))
    text = F.concat(rest, F.when(F.trim(rest) == "{", "").otherwise(","), added)
    return n.withColumn("properties", text).drop("_d", "_h", "_c", "_l")


def build(store: Store, repo: str, files: DataFrame | None = None, analyze: bool = True, hubs: int = model.HUBS, now: int | None = None) -> dict:
    """Full build of one checkout: extract, enrich, analyse, write by hash gate, record the commit.

    Nodes and edges that vanished from the source go; rows of other checkouts stay. Returns counts.
    """
    spark, now = store.spark, int(now or time.time())
    files = cut(files if files is not None else scan.read_tree(spark, repo))
    nodes, edges = extract(files)
    new, new_edges = _enriched(files, cut(nodes), cut(edges))
    if analyze:
        new = cut(analyse(PropertyGraph(new, new_edges), hubs))
    stored, stored_edges = store.table("nodes"), store.table("edges")
    mine, mine_edges = stored.where(F.col(R) == repo), stored_edges.where(F.col(R) == repo)
    state = upserts.gate_nodes(mine, new).groupBy("state").count().collect()
    merged = semi(upserts.upsert_nodes(mine, _shaped(new, now), now), new, {R: R, "id": "id"})
    merged = upserts.refresh_properties(merged, new)
    others, other_edges = stored.where(F.col(R) != repo), stored_edges.where(F.col(R) != repo)
    store.commit(
        {"nodes": others.unionByName(merged), "edges": other_edges.unionByName(_shaped_edges(new_edges, now))},
        {repo: {"last_commit": scan.head_commit(repo) or "", "last_build_at": now}},
    )
    return {r.state: r["count"] for r in state}


def _enriched(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    why = cut(enrich.extract_rationale(files))
    both = nodes.unionByName(why.select(*nodes.columns))
    e = enrich.with_confidence(edges.unionByName(enrich.explains(why, nodes).select(*edges.columns)))
    return cut(both), cut(e)


def _shaped(nodes: DataFrame, now: int) -> DataFrame:
    return nodes.withColumn("updated_at", F.lit(now).cast("long")).select(*[f.name for f in model.NODES.fields])


def _shaped_edges(edges: DataFrame, now: int) -> DataFrame:
    return edges.withColumn("built_at", F.timestamp_seconds(F.lit(now))).select(*[f.name for f in model.EDGES.fields])


def update(store: Store, repo: str, files: DataFrame | None = None, changed: list[str] | None = None, analyze: bool = True, now: int | None = None) -> dict:
    """Incremental build from the files that changed since the recorded commit.

    Confidence is set before writing, and references from unchanged files into changed ones are resolved again, since
    deleting a file's nodes takes the edges that lead to them. Marks the node summaries of changed nodes and their
    neighbours stale. Unknown endings are reported, not fatal.
    """
    spark, now = store.spark, int(now or time.time())
    head, last = scan.head_commit(repo), store.last_commit(repo)
    if changed is None:
        if head and head == last:
            return {"no_change": True}
        changed = [r.file for r in scan.changed_files(spark, repo, last).collect()] if last else None
        if not changed:
            if last is not None and head:
                store.commit({}, {repo: {"last_commit": head, "last_build_at": now}})
                return {"no_change": True}
            return build(store, repo, files, analyze, now=now)
    known = {e for es, _ in EXTRACTORS.values() for e in es}
    warnings = [f"no extractor for {c}" for c in changed if c.rsplit(".", 1)[-1].lower() not in known]
    files = cut(files if files is not None else scan.read_tree(spark, repo))
    touched = spark.createDataFrame([(repo, c) for c in changed], f"{R} string, file string")
    old = PropertyGraph(cut(store.table("nodes").where(F.col(R) == repo)), cut(store.table("edges").where(F.col(R) == repo)))
    nodes, edges = extract(files)  # references cross files, so resolution sees the whole checkout
    new, new_edges = _enriched(files, cut(nodes), cut(edges))
    fresh = semi(new, touched, {R: R, "file": "file"})
    targets = cut(invalidation_targets(old, semi(new, old.nodes.where("file is not null"), {R: R, "file": "file"}).unionByName(fresh).distinct(), touched))
    kept = semi(old.nodes, new, {R: R, "id": "id"})
    merged = upserts.upsert_nodes(kept, _shaped(new, now), now)
    if analyze:
        merged = cut(analyse(PropertyGraph(merged, new_edges)))
    s = store.table("summaries")
    gone = semi(old.nodes, new, {R: R, "id": "id"}, "left_anti")
    s = semi(upserts.mark_stale(s, targets), gone, {R: R, "node_id": "id"}, "left_anti")
    others = store.table("nodes").where(F.col(R) != repo), store.table("edges").where(F.col(R) != repo)
    counts = {"changed_files": len(changed), "invalidated": targets.count(), "warnings": warnings}
    store.commit({"nodes": others[0].unionByName(merged.select(*[f.name for f in model.NODES.fields])), "edges": others[1].unionByName(_shaped_edges(new_edges, now)), "summaries": s}, {repo: {"last_commit": head or "", "last_build_at": now}})
    return counts


# --- catalog ---------------------------------------------------------------------------------------------------

def key_of(path: str) -> str:
    return hashlib.sha256(os.path.abspath(path).encode()).hexdigest()[:16]


def store_folder(root: str, repo: str) -> str:
    return os.path.join(root, key_of(repo))


def discover(spark: SparkSession, root: str) -> list[dict]:
    """Stores below a folder, by key: key, status (built, never-built, unreadable), repo_path, last_commit, counts, freshness."""
    out = []
    for key in sorted(os.listdir(root)) if os.path.isdir(root) else []:
        folder = os.path.join(root, key)
        if not os.path.isdir(folder):
            continue
        row = {"key": key, "folder": folder, "status": "unreadable", "repo_path": None, "last_commit": None, "n_nodes": 0, "n_edges": 0, "freshness": "unknown", "bytes": size_of(folder)}
        try:
            r = StoreReader(spark, folder)
            meta = r.state()["meta"]
            if meta:
                repo, m = max(meta.items(), key=lambda x: (x[1].get("last_build_at") or 0, x[0]))
                row |= {"status": "built", "repo_path": repo, "last_commit": m.get("last_commit"), "n_nodes": r.table("nodes").count(), "n_edges": r.table("edges").count(), "freshness": scan.freshness(repo, m.get("last_commit"))}
            else:
                row["status"] = "never-built"
        except Exception as e:  # one broken store must not hide the others
            row["error"] = str(e)[:200]
        out.append(row)
    return out


def size_of(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


def remove(root: str, key: str) -> bool:
    """Delete one store; refuses anything but a plain name below the root. False where it was gone already."""
    if not key or key in (".", "..") or os.sep in key or (os.altsep and os.altsep in key) or os.path.isabs(key):
        raise ValueError(f"not a store key: {key!r}")
    path = os.path.realpath(os.path.join(root, key))
    if os.path.dirname(path) != os.path.realpath(root):
        raise ValueError(f"{key!r} leaves the store root")
    if not os.path.isdir(path):
        return False
    shutil.rmtree(path)
    return True


def prune_candidates(found: list[dict]) -> list[dict]:
    """Stores never built or whose checkout is gone; unreadable and stale ones are kept."""
    return [x for x in found if x["status"] == "never-built" or (x["status"] == "built" and x["freshness"] == "missing")]

