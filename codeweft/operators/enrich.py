"""Rationale comments and docstrings as nodes, their nearest entity, and the confidence of edges."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import columns as X
from codeweft.operators.graph import R, lookup
from codeweft.runtime import spread

# Tags of rationale comments, declarations that documentation can precede.
_TAGGED = re.compile(r"(NOTE|WHY|HACK|TODO|FIXME|WARNING):\s*(.*)", re.ASCII)
_GO_DECLARED = re.compile(r"(func|type|var|const)\s", re.ASCII)
_PY_DECLARED = re.compile(r"\s*(def|class)\s+\w+", re.ASCII)
_BLOCK_DECLARED = re.compile(r"\s*(export\s+)?(default\s+)?(public\s+|private\s+|protected\s+)?(abstract\s+)?(async\s+)?(function|class|const|interface|type|enum)\s", re.ASCII)


def with_confidence(edges: DataFrame) -> DataFrame:
    """Edges with a confidence where they had none, from their type."""
    return edges.withColumn("confidence", X.confidence("type", "confidence"))


def tagged_comments(lines: list[str], mark: str) -> Iterator[tuple[int, int, str, str]]:
    """(first line, last line, kind, text) of tagged line comments; untagged comment lines right below belong to them."""
    open_at, kind, parts = 0, "", []
    for no, raw in enumerate([*lines, ""], 1):
        s = raw.strip()
        body = s[len(mark) :].strip() if s.startswith(mark) else None
        tag = _TAGGED.fullmatch(body) if body else None
        if open_at and (not body or tag):
            yield open_at, no - 1, kind, " ".join(parts)
            open_at = 0
        if tag and tag[2].strip():
            open_at, kind, parts = no, tag[1], [tag[2].strip()]
        elif open_at and body:
            parts.append(body)


def go_docs(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """Comment lines directly above a declaration, unless a single tagged one."""
    run: list[str] = []
    for no, raw in enumerate(lines, 1):
        s = raw.strip()
        if s.startswith("//"):
            run.append(s[2:].strip())
            continue
        if run and _GO_DECLARED.match(raw) and not (len(run) == 1 and _TAGGED.fullmatch(run[0])) and (text := " ".join(run).strip()):
            yield no - len(run), no - 1, text
        run = []


def python_docs(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """Triple-quoted strings on the first line with text below a def or class."""
    for no, raw in enumerate(lines):
        if not _PY_DECLARED.match(raw):
            continue
        first = next((k for k in range(no + 1, len(lines)) if lines[k].strip()), None)
        if first is None or (quote := lines[first].strip()[:3]) not in ('"""', "'''"):
            continue
        parts, last, rest = [], first, lines[first].strip()[3:]
        while quote not in rest and last + 1 < len(lines):
            parts.append(rest)
            last += 1
            rest = lines[last]
        parts.append(rest.split(quote, 1)[0])
        if text := " ".join(parts).strip():
            yield first + 1, last + 1, text


def block_docs(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """/** */ blocks with a declaration on the next line that has text."""
    no = 0
    while no < len(lines):
        if not lines[no].strip().startswith("/**"):
            no += 1
            continue
        end = next((k for k in range(no, len(lines)) if "*/" in lines[k]), len(lines) - 1)
        after = next((x for x in lines[end + 1 :] if x.strip()), "")
        words = [re.sub(r"^\*+", "", re.sub(r"^/\*+", "", x.strip().split("*/")[0])).strip() for x in lines[no : end + 1]]
        if _BLOCK_DECLARED.match(after) and (text := " ".join(w for w in words if w).strip()):
            yield no + 1, end + 1, text
        no = end + 1


def rationale_of(file: str, content: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, kind, text) of everything in a file that explains something."""
    lines, ending = content.split("\n"), file.rsplit(".", 1)[-1].lower() if "." in file else ""
    found = list(tagged_comments(lines, "#" if ending == "py" else "//"))
    docs = {"go": go_docs, "py": python_docs}.get(ending, block_docs if ending in ("ts", "tsx", "js", "jsx", "java") else None)
    return found + [(a, b, "DOCSTRING", t) for a, b, t in (docs(lines) if docs else ())]


RATIONALE = "repo_path string, id string, type string, file string, line_start int, line_end int, signature string, hash string, properties string, kind string, text string"


def _rationale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import json

    for b in batches:
        rows = []
        for repo, file, content in zip(b[R], b["file"], b["content"]):
            for a, z, kind, text in rationale_of(file, content):
                rows.append((repo, f"rationale:{file}:{a}:{kind}", "Rationale", file, a, z, f"{kind}: {text}", hashlib.sha256((kind + text).encode()).hexdigest(), json.dumps({"kind": kind, "text": text}, ensure_ascii=False), kind, text))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in RATIONALE.split(", ")]).astype({"line_start": "int32", "line_end": "int32"})


def extract_rationale(source_files: DataFrame) -> DataFrame:
    """Rationale nodes of files (repo_path, file, content), each id once; files without content give none."""
    rows = source_files.where("content is not null and file is not null").select(R, "file", "content")
    return spread(rows).mapInPandas(_rationale, RATIONALE).dropDuplicates([R, "id"])


#: Lines in a block of a file; bounds the rows any window holds.
LINES = 4096


def nearest_entity(comments: DataFrame, entities: DataFrame) -> DataFrame:
    """Forward as-of join: comments (repo_path, id, file, line_end) with the ``entity`` they explain.

    The first entity of the file (repo_path, id, file, line_start) starting at or after the comment's end, ties by id,
    else the last one; files without entities are left out. Answers are made once per line, within blocks of lines and
    then from block to block, so a file holding most rows is no single group.
    """
    key = [R, "file"]
    e = entities.where("file is not null and line_start is not null").select(*key, F.col("line_start").alias("line"), "id")
    m = comments.where("file is not null and line_end is not null").select(*key, F.col("line_end").alias("line"), "id")
    block = F.floor(F.col("line") / LINES).cast("int")
    starts = e.groupBy(*key, "line").agg(F.min(F.struct("line", "id")).alias("e"))
    asked = m.select(*key, "line").distinct()
    both = starts.select(*key, "line", "e", F.lit(False).alias("asked")).unionByName(asked.select(*key, "line", F.lit(None).cast(starts.schema["e"].dataType).alias("e"), F.lit(True).alias("asked")))
    lines = both.groupBy(*key, "line").agg(F.max("e").alias("e"), F.max("asked").alias("asked")).withColumn("block", block)
    inside = F.first("e", ignorenulls=True).over(Window.partitionBy(*key, "block").orderBy("line").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    here = lines.withColumn("after", inside).where("asked")
    blocks = lines.groupBy(*key, "block").agg(F.min("e").alias("first"))
    w = Window.partitionBy(*key).orderBy("block")  # one row for each block of a file
    beyond = blocks.select(*key, "block", F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("beyond"))
    last = e.groupBy(*key).agg(F.max(F.struct("line", "id")).alias("last"))
    told = lookup(lookup(here, beyond, {R: R, "file": "file", "block": "block"}, {"beyond": "beyond"}), last, {R: R, "file": "file"}, {"last": "last"}, "inner")
    told = told.select(*key, "line", F.coalesce("after", "beyond", "last").alias("v"))
    return lookup(m, told, {R: R, "file": "file", "line": "line"}, {"v": "v"}, "inner").select(R, "id", F.col("v.id").alias("entity"))


def explains(comments: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges from rationale nodes to what they explain."""
    return nearest_entity(comments, entities).select(
        R, X.edge_id(F.lit("explains"), "id", "entity").alias("id"), F.lit("explains").alias("type"), F.col("id").alias("src_id"), F.col("entity").alias("dst_id"), F.lit("INFERRED").alias("confidence"), F.lit("null").alias("properties")
    )
