"""What is told about a node: relations, rationale, related nodes within a token budget, and the texts made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft import model
from codeweft.functions import columns as X
from codeweft.operators.analytics import labels
from codeweft.operators.graph import R, PropertyGraph, lookup
from codeweft.operators.search import resolve, search
from codeweft.operators.traversal import expand


def relations(g: PropertyGraph, targets: DataFrame) -> DataFrame:
    """Direct relations of (repo_path, target): direction, type, other, confidence ('?' where unknown). One row each."""
    t = targets.select(F.col(R).alias("_r"), "target").distinct()
    conf = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("?")).alias("confidence")
    out = t.join(g.edges, (F.col("_r") == F.col(R)) & (F.col("target") == F.col("src_id"))).select(R, "target", F.lit("out").alias("direction"), "type", F.col("dst_id").alias("other"), conf)
    into = t.join(g.edges, (F.col("_r") == F.col(R)) & (F.col("target") == F.col("dst_id"))).select(R, "target", F.lit("in").alias("direction"), "type", F.col("src_id").alias("other"), conf)
    return out.unionByName(into)


def rationale(g: PropertyGraph, targets: DataFrame | None = None) -> DataFrame:
    """(repo_path, target, rationale_id, kind, text): what explains each node, from its explains edges."""
    e = g.edges.where("type = 'explains'").select(R, F.col("dst_id").alias("target"), F.col("src_id").alias("rationale_id"))
    if targets is not None:
        t = targets.select(F.col(R).alias("_r"), F.col("target").alias("_t")).distinct()
        e = e.join(t, (F.col(R) == F.col("_r")) & (F.col("target") == F.col("_t")), "left_semi")
    r = lookup(e, g.nodes, {R: R, "rationale_id": "id"}, {"p": "properties"}, "inner")
    return r.select(R, "target", "rationale_id", X.text_prop("p", "kind").alias("kind"), X.text_prop("p", "text").alias("text"))


def related_lines(g: PropertyGraph, found: DataFrame, summaries: DataFrame) -> DataFrame:
    """One line per expanded node other than its target, with its token estimate."""
    d = lookup(found.where("id <> target"), g.nodes, {R: R, "id": "id"}, {"node_type": "type"})
    d = lookup(d, summaries.where("level = 'node'"), {R: R, "id": "node_id"}, {"s": "summary"})
    told = F.coalesce(F.nullif("s", F.lit("")), F.lit(model.NO_SUMMARY))
    conf = F.coalesce(F.nullif("confidence", F.lit("")), F.lit("?"))
    tail = F.concat(F.lit(" ("), F.col("node_type"), F.lit("): "), told, F.lit("\n"))
    arrow = F.concat(F.lit(" --"), F.col("via_edge"), F.lit("("), conf, F.lit(")--> "))
    hop = F.concat(F.lit("- [hop "), F.col("hop").cast("string"), F.lit("] "))
    line = (
        F.when(F.col("parent_id").isNull(), F.concat(F.lit("- [seed] "), "id", tail))
        .when(F.col("outgoing"), F.concat(hop, "parent_id", arrow, "id", tail))
        .otherwise(F.concat(hop, "id", arrow, "parent_id", tail))
    )
    return d.select(R, "target", "id", "hop", "weight", line.alias("line")).withColumn("tokens", X.estimate_tokens("line"))


def within_budget(lines: DataFrame, max_tokens: int = model.MAX_TOKENS, used: int = 0) -> DataFrame:
    """The first lines of each target that fit a budget, at least one; nearest hop, then heaviest, then id.

    A line costs at least one token, so no more than ``max_tokens`` lines of a target are ever ordered in one place.
    """
    by = [F.col("hop"), F.desc("weight"), F.col("id")]
    w = Window.partitionBy(R, "target").orderBy(*by)
    top = lines.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, max_tokens))
    return top.withColumn("running", F.sum("tokens").over(Window.partitionBy(R, "target").orderBy("rank")) + used).where((F.col("running") <= max_tokens) | (F.col("rank") == 1))


# --- texts of one node, made on the driver -----------------------------------------------------------------------

def estimate(text: str) -> int:
    n = len(text.encode())
    return n // 3 + 1 if n else 0


class Teller:
    """Texts about nodes of one checkout. Rows are streamed to the driver; a text is as long as what it tells."""

    def __init__(self, g: PropertyGraph, summaries: DataFrame, members: DataFrame | None = None, degree: DataFrame | None = None, hubs: DataFrame | None = None) -> None:
        self.g, self.summaries, self.members, self.degree, self.hubs = g, summaries, members, degree, hubs

    def _one(self, repo: str, node: str) -> DataFrame:
        return self.g.nodes.where((F.col(R) == repo) & (F.col("id") == node)).select(R, F.col("id").alias("target"))

    def target_section(self, repo: str, node: str) -> str:
        at = (F.col(R) == repo) & (F.col("id") == node)
        row = self.g.nodes.where(at).first()
        if row is None:
            raise KeyError(f"no node {node!r} in {repo!r}")
        s = self.summaries.where((F.col(R) == repo) & (F.col("node_id") == node) & (F.col("level") == "node")).first()
        out = [f"# {node} ({row.type})"]
        if row.signature:
            out.append(f"Signature: {row.signature}")
        out.append(f"Summary: {(s and s.summary) or model.NO_SUMMARY}")
        if self.members is not None and (m := self.members.where(at).first()):
            label = labels(self.g.nodes, self.members.where(F.col(R) == repo)).where(F.col("community") == m.community).first()
            out.append(f"Community: {label.label} (id {m.community})")
        if self.hubs is not None and (h := self.hubs.where(at).first()):
            out.append(f"God node: yes (degree {h.degree})")
        by_type: dict[str, tuple[str, list[str]]] = {}
        for r in relations(self.g, self._one(repo, node)).orderBy(F.desc("direction"), "type", "other").toLocalIterator():
            label = r.type if r.direction == "out" else f"called_by/referenced_by:{r.type}"
            by_type.setdefault(r.type, (label, []))[1].append(f"{r.other}({r.confidence})")
        if by_type:
            out.append("Direct relations:")
            out += [f"  {label}: {', '.join(sorted(entries))}" for label, entries in by_type.values()]
        why = [f"  [{r.kind}] {r.text}" for r in rationale(self.g, self._one(repo, node)).orderBy("rationale_id").toLocalIterator()]
        if why:
            out += ["Rationale:", *why]
        return "\n".join(out) + "\n"

    def context_of(self, repo: str, node: str, hops: int = model.HOPS, max_tokens: int = model.MAX_TOKENS, seeds: list[str] = (), head: str = "") -> str:
        section = head + self.target_section(repo, node)
        found = expand(self.g, self._one(repo, node), hops, self.members)
        if seeds:
            extra = self.g.nodes.where((F.col(R) == repo) & F.col("id").isin(list(seeds))).select(R, F.lit(node).alias("target"), "id")
            known = found.select(F.col("id").alias("_i"))
            extra = extra.join(known, F.col("id") == F.col("_i"), "left_anti")
            found = found.unionByName(extra.withColumns({"hop": F.lit(0), "weight": F.lit(0)}), allowMissingColumns=True)
        lines = related_lines(self.g, found, self.summaries)
        total = lines.count()
        if not total:
            return section
        title = "\nRelated nodes:\n"
        kept = within_budget(lines, max_tokens, estimate(section) + estimate(title)).orderBy("rank").collect()
        rest = total - len(kept)
        return section + title + "".join(r.line for r in kept) + (f"... ({rest} more node(s) omitted to fit the token budget)\n" if rest else "")

    def context(self, repo: str, target: str, hops: int = model.HOPS, max_tokens: int = model.MAX_TOKENS) -> str:
        hit = resolve(self.g.nodes, self.summaries, target).where(F.col(R) == repo).first()
        if hit is None:
            raise KeyError(f"nothing matches {target!r}")
        return self.context_of(repo, hit.id, hops, max_tokens)

    def query(self, repo: str, question: str, hops: int = model.HOPS, max_tokens: int = model.MAX_TOKENS) -> str:
        hits = [r.id for r in search(self.g.nodes.where(F.col(R) == repo), self.summaries, question, model.SEEDS).orderBy("rank").collect()]
        if not hits:
            raise KeyError(f"nothing matches {question!r}")
        return self.context_of(repo, hits[0], hops, max_tokens, hits[1:], f"Query: {question}\n\n")

    def explain(self, repo: str, node: str, hops: int = 1) -> str:
        text = self.target_section(repo, node)
        if hops > 1:
            lines = related_lines(self.g, expand(self.g, self._one(repo, node), hops, self.members), self.summaries).orderBy("hop", F.desc("weight"), "id")
            text += "\nRelated nodes:\n" + "".join(r.line for r in lines.toLocalIterator())
        return text

    def prompt(self, repo: str, node: str, max_tokens: int = model.MAX_TOKENS) -> str:
        """Markdown sections; relations and nodes two hops away are cut to the budget, rationale and community never."""
        section = self.target_section(repo, node).split("\n")
        head = [x for x in section if x.startswith(("# ", "Signature:", "Summary:"))]
        used = estimate("\n".join(head))
        out = [*head, "", "## Direct Relations"]
        for r in relations(self.g, self._one(repo, node)).orderBy(F.desc("direction"), "type", "other").toLocalIterator():
            line = f"- {r.type} -> {r.other} ({r.confidence})" if r.direction == "out" else f"- {r.type} <- {r.other} ({r.confidence})"
            used += estimate(line)
            if used > max_tokens:
                break
            out.append(line)
        out += ["", "## Related Nodes"]
        lines = related_lines(self.g, expand(self.g, self._one(repo, node), 2, self.members).where("hop = 2"), self.summaries)
        out += [r.line.rstrip("\n") for r in within_budget(lines, max_tokens, used).orderBy("rank").collect() if r.running <= max_tokens]
        why = [f"- [{r.kind}] {r.text}" for r in rationale(self.g, self._one(repo, node)).orderBy("rationale_id").toLocalIterator()]
        out += ["", "## Rationale", *why, "", "## Community", *[x for x in section if x.startswith("Community:")]]
        return "\n".join(out) + "\n"
