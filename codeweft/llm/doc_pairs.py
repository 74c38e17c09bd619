"""Functions with the documentation that describes them.

A file gives functions and comments. Every comment before a function, and the string that opens its body, is a candidate
for it as long as distance alone does not rule it out. A link costs what speaks against it: lines and foreign code in
between, a place that is not where the language's tools look for documentation, parameter tags that name no parameter,
the name of another function. Tags that name the function's parameters and mention of its own name lower the cost. Links
at ``REJECT`` or above are implausible and dropped; over the rest a minimum-cost bipartite assignment gives each function
at most one comment and each comment at most one function. An exact check then keeps links that are documentation as the
language defines it, and descriptions that say something.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.declarations import Function, functions
from codeweft.functions.lexing import Token, language_of, normalise, scan
from codeweft.runtime import spread

#: Cost from which a link is implausible.
REJECT = 3.0
#: What a line in between, a line of foreign code in between, a place that is not the language's, wrong parameter tags and
#: the name of another function cost; right tags and the own name take off as much.
COSTS = {"line": 0.2, "code": 0.8, "place": 2.0, "tags": 0.5, "names": 0.5}
#: Different words a description must keep.
LEAST_WORDS = 4


@dataclass(slots=True)
class Comment:
    tokens: list[Token]
    start: int
    end: int
    form: str  # doc, block, line, docstring


@dataclass(slots=True)
class Pair:
    function: Function
    text: str
    form: str
    cost: float
    documents: bool  # whether the exact check holds
    plain: str = field(default="")


# --- comments and candidates -----------------------------------------------------------------------------------

def _groups(tokens: list[Token], text: str) -> list[Comment]:
    """Comments in order; those that stand alone on their lines and touch line by line are one in Go and Python."""
    out: list[Comment] = []
    before = False
    for t in tokens:
        joins, own_line = before, not text[text.rfind("\n", 0, t.start) + 1 : t.start].strip()
        before = own_line
        if out and joins and own_line:
            gap = text[out[-1].end : t.start]
            if not gap.strip() and gap.count("\n") <= 1:
                out[-1].tokens.append(t)
                out[-1].end = t.end
                continue
        out.append(Comment([t], t.start, t.end, t.kind))
    return out


_BETWEEN = re.compile(r"(?:\s*@(?!interface\b)[\w.$]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?)*\s*")
_DOCSTRING = re.compile(r"[rRuU]{0,2}[\"']")


def _candidates(f: Function, comments: list[Comment], starts: list[int], strings: dict[int, Token], text: str, code: str, language: str, w: dict[str, float]) -> Iterator[tuple[Comment, float, bool]]:
    """Comments near a function, what their distance and place cost, and whether the language takes them for its documentation."""
    k = bisect.bisect_left(starts, f.start) - 1
    nearest = True
    while k >= 0:
        c = comments[k]
        between = code[c.end : f.start]
        lines = text.count("\n", c.end, f.start)
        foreign = 0
        if between.strip():
            if language not in ("go", "python") and _BETWEEN.fullmatch(between):
                lines = 1  # annotations belong to the declaration
            else:
                foreign = sum(1 for x in between.split("\n") if x.strip())
        cost = w["line"] * max(0, lines - 1) + w["code"] * foreign
        if cost >= REJECT:
            break
        if language == "go":
            right = nearest and lines == 1 and not foreign and not text[text.rfind("\n", 0, c.start) + 1 : c.start].strip()
        else:
            right = language != "python" and nearest and c.form == "doc" and not foreign
        yield c, cost + (0.0 if right else w["place"]), right
        nearest = False
        k -= 1
    if language == "python":
        at = f.end
        while m := _REMARK.match(text, at):
            at = m.end()
        at = _BLANKS.match(text, at).end()
        if (t := strings.get(at)) and _DOCSTRING.match(text, at):
            yield Comment([t], t.start, t.end, "docstring"), 0.0, True


# --- assignment ------------------------------------------------------------------------------------------------

def assign(costs: list[list[float]]) -> list[int]:
    """Minimum-cost assignment of rows to different columns (rows <= columns): the column of each row. O(n^2 m)."""
    cost = np.asarray(costs, float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = int(free[least[free].argmin()])
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = int(way[j0])
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


# --- what a description says -----------------------------------------------------------------------------------

_TAG = re.compile(r"^[@:\\](?:param|parameter|arg|args|argument|type|return|returns|rtype|raise|raises|throws|exception|yields?|template|typedef|property)\b", re.I)
_TAG_NAME = re.compile(r"[@:](?:param|arg|argument)\s+(?:\{[^}]*\}\s*)?(?:\w+\s+)?\[?([A-Za-z_$][\w$]*)")
_NOTE = re.compile(r"^(?:NOTE|WHY|HACK|TODO|FIXME|WARNING)\b")
_DIRECTIVE = re.compile(r"^(?:go:\w|nolint\b|lint:|noqa\b|pylint:|type:\s*ignore|mypy:|eslint\b|eslint-|tslint:|prettier-ignore|@ts-|ts-ignore|istanbul\b|c8\b|nosec\b|fmt:\s*(?:off|on)|isort:|pragma\b|#pragma|\+build\b|export\s+\w+$|@formatter:|checkstyle:|NOSONAR|noinspection\b|spell-?checker:|cspell:|region\b|endregion\b)", re.I)
_SECTION = re.compile(r"^(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws)\s*:\s*$")
_SECTION_RULE = re.compile(r"^-{3,}\s*$")
_IDENTIFIER = re.compile(r"[\w$]+")
_BLANK = re.compile(r"\s+")
_REMARK, _BLANKS, _INLINE_TAG = re.compile(r"(?:[ \t\n]|\\\n)*#[^\n]*"), re.compile(r"(?:[ \t\n]|\\\n)*"), re.compile(r"\{@\w+\s*([^}]*)\}")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def description(c: Comment, text: str) -> str:
    """The comment's lines without their markers."""
    lines: list[str] = []
    for t in c.tokens:
        body = text[t.start : t.end]
        if c.form == "docstring":
            body = re.sub(r"^[A-Za-z]{0,2}(\"\"\"|'''|\"|')", "", body)
            body = re.sub(r"(\"\"\"|'''|\"|')$", "", body)
            lines += body.split("\n")
        elif t.kind == "line":
            lines.append(re.sub(r"^(?://+!?|#+)", "", body))
        else:
            lines += [re.sub(r"^\s*\*+(?!/)", "", x) for x in re.sub(r"\*+/$", "", re.sub(r"^/\*+!?", "", body)).split("\n")]
    return "\n".join(x.strip() if c.form != "docstring" else x.rstrip() for x in lines).strip("\n")


def informative(plain: str) -> str:
    """What is left of a description without directives, tag lines, sections of parameters and note lines."""
    kept, section, indent = [], False, 0
    lines = plain.split("\n")
    for k, raw in enumerate(lines):
        line = raw.strip()
        depth = len(raw) - len(raw.lstrip())
        if _SECTION.match(line) or (k + 1 < len(lines) and re.match(r"^(?:Parameters|Returns|Raises|Yields)$", line) and _SECTION_RULE.match(lines[k + 1].strip())):
            section, indent = True, depth
            continue
        if section:
            if line and depth <= indent and not re.match(r"^\*{0,2}\w+\s*(?:\([^)]*\))?\s*:", line) and not _SECTION_RULE.match(line):
                section = False
            else:
                continue
        if not line or _TAG.match(line) or _NOTE.match(line) or _DIRECTIVE.match(line):
            continue
        kept.append(line)
    return _INLINE_TAG.sub(r"\1", "\n".join(kept))


def name_parts(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    return {p.lower() for p in parts} | {name.lower()} | {x.lower() for x in name.split("_") if x}


def words_left(plain: str, name: str) -> int:
    return len(set(_WORD.findall(informative(plain).lower())) - name_parts(name) - {"inheritdoc"})


@dataclass(slots=True)
class _Said:
    plain: str
    tags: set[str]
    names: set[str]
    words: set[str]


def links(content: str, language: str, w: dict[str, float] = COSTS) -> list[Pair]:
    """The assignment: every function with the comment that goes with it best, whether or not it is its documentation."""
    text = normalise(content)
    tokens, code = scan(text, language)
    found = functions(code, language)
    if not found:
        return []
    strings = {t.start: t for t in tokens if t.kind == "string"}
    comments = _groups([t for t in tokens if t.kind != "string"], text) if language in ("go", "python") else [Comment([t], t.start, t.end, t.kind) for t in tokens if t.kind != "string"]
    starts = [c.start for c in comments]
    declared = {f.name for f in found}
    said: dict[int, _Said] = {}

    def reading(c: Comment) -> _Said:
        if c.start not in said:
            plain = description(c, text)
            said[c.start] = _Said(plain, set(_TAG_NAME.findall(plain)), declared.intersection(_IDENTIFIER.findall(plain)), set(_WORD.findall(plain.lower())))
        return said[c.start]

    # plausible links; functions and comments that share some form a component, and each is solved on its own
    edges: list[tuple[int, Comment, float, bool]] = []
    for i, f in enumerate(found):
        for c, cost, right in _candidates(f, comments, starts, strings, text, code, language, w):
            r, own = reading(c), set(f.params)
            if r.tags:
                cost += w["tags"] * (len(r.tags - own) - len(r.tags & own)) / len(r.tags)
            if f.name in r.names:
                cost -= w["names"]
            elif r.names:
                cost += w["names"]
            elif not name_parts(f.name).isdisjoint(r.words):
                cost -= 0.2 * w["names"]
            if cost < REJECT:
                edges.append((i, c, cost, right))
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, c, *_ in edges:
        parent[root(("f", i))] = root(("c", c.start))
    groups: dict = {}
    for e in edges:
        groups.setdefault(root(("f", e[0])), []).append(e)
    out: list[Pair] = []
    for group in groups.values():
        if len(group) == 1:
            chosen = group
        else:
            rows, order = sorted({e[0] for e in group}), sorted({e[1].start for e in group})
            row, column = {i: a for a, i in enumerate(rows)}, {x: b for b, x in enumerate(order)}
            # one spare column for each function at the cost of rejection: no link is better than an implausible one
            costs = np.full((len(rows), len(order) + len(rows)), 3 * REJECT)
            costs[np.arange(len(rows)), len(order) + np.arange(len(rows))] = REJECT
            at = {}
            for e in group:
                costs[row[e[0]], column[e[1].start]] = e[2]
                at[row[e[0]], column[e[1].start]] = e
            chosen = [at[a, j] for a, j in enumerate(assign(costs)) if (a, j) in at]
        out += [Pair(found[i], text[found[i].start : found[i].end], c.form, round(cost, 3), right, reading(c).plain) for i, c, cost, right in chosen]
    return sorted(out, key=lambda p: p.function.at)


def pairs(content: str, language: str) -> list[Pair]:
    """Every function with its documentation text; functions without, or with a trivial one, are left out."""
    return [p for p in links(content, language) if p.documents and words_left(p.plain, p.function.name) >= LEAST_WORDS]


OUT = "file_id bigint, line_no int, col_no int, func_name string, mark bigint, language string, signature string, form string, doc string, cost double"


def _files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for file_id, file, language, content, mark in zip(b["file_id"], b["file"], b["language"], b["content"], b["mark"]):
            lang = language_of(file, language)
            if content is None or lang not in ("python", "go", "java", "typescript", "javascript"):
                continue
            text = normalise(content)
            line, seen = 1, 0
            for p in pairs(content, lang):
                at = p.function.at
                line, seen = line + text.count("\n", seen, at), at
                rows.append((file_id, line, at - text.rfind("\n", 0, at), p.function.name, mark, lang, _BLANK.sub(" ", p.text).strip(), p.form, p.plain.strip(), p.cost))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"file_id": "int64", "line_no": "int32", "col_no": "int32", "mark": "int64", "cost": "float64"})


def doc_pairs(source_files: DataFrame) -> DataFrame:
    """One row per documented function: file_id, line_no, col_no, func_name, language, signature, form, doc, cost.

    Null contents, unknown languages and rows without file_id give nothing; copies of a row count once, and where contents
    of one file_id differ a function found at one place in several is taken from the one with the least fingerprint; whole
    texts are read, whatever their length; a file that does not parse gives what could be read. Extra columns are ignored.
    """
    rows = source_files.where("content is not null and file_id is not null").select("file_id", "file", "language", "content", F.xxhash64("file", "language", "content").alias("mark"))
    keys = ["file_id", "line_no", "col_no", "func_name"]
    rest = ["language", "signature", "form", "doc", "cost"]
    return spread(rows).mapInPandas(_files, OUT).groupBy(*keys).agg(F.min_by(F.struct(*rest), "mark").alias("r")).select(*keys, "r.*")
