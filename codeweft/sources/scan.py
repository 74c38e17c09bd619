"""Source trees, git state, delivered summaries and stored graphs as DataFrames."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.functions import columns as X
from codeweft.operators.graph import R
from codeweft.sources.extract import EXTRACTORS, MANIFESTS, SKIPPED_DIRS

#: Root files that name a language, by priority, and languages on equal counts. Fixed values.
MARKERS = [("go.mod", "go"), ("pom.xml", "java"), ("build.gradle", "java"), ("build.gradle.kts", "java"), ("tsconfig.json", "typescript"), ("package.json", "javascript"), ("pyproject.toml", "python"), ("setup.py", "python"), ("requirements.txt", "python")]
PRIORITY = ["go", "java", "typescript", "javascript", "python"]
BY_ENDING = {"go": "go", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python"}


def read_tree(spark: SparkSession, repo: str, folders: list[str] | None = None) -> DataFrame:
    """Files of a checkout on any Hadoop file system: repo_path, file, language, content. Known endings and manifests only.

    ``folders`` (paths below the checkout) narrows the scan, as an update needs it. Contents stay on the executors.
    """
    root = repo.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{root}/{x}" for x in folders] if folders else root)
    base = root.split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), "^" + base.replace(".", r"\.") + "/", "")
    endings = sorted({e for es, _ in EXTRACTORS.values() for e in es})
    df = files.select(F.lit(repo).alias(R), rel.alias("file"), F.decode("content", "UTF-8").alias("content"))
    wanted = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(endings) | X.base_name("file").isin(sorted([*MANIFESTS, *(m for m, _ in MARKERS)]))
    skipped = F.exists(F.split("file", "/"), lambda p: p.isin(sorted(SKIPPED_DIRS)))
    return df.where(wanted & ~skipped).withColumn("language", language_of_file("file"))


def language_of_file(file):
    ending = F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for e, lang in BY_ENDING.items():
        out = F.when(ending == e, lang).otherwise(out)
    return out


def detect_languages(files: DataFrame) -> DataFrame:
    """(repo_path, language, rank, by): languages of each checkout, the primary one with rank 1.

    By marker files in the root, in order of priority; package.json counts only without tsconfig.json. Checkouts without
    markers get the language with most files (ties by priority), hidden and vendored folders left out.
    """
    root = files.where(~F.contains("file", F.lit("/"))).select(R, "file").distinct()
    order = {lang: k for k, lang in enumerate(PRIORITY)}
    pairs = F.create_map(*[x for m, lang in reversed(MARKERS) for x in (F.lit(m), F.lit(lang))])
    marked = root.select(R, "file", pairs[F.col("file")].alias("language")).where("language is not null")
    ts = F.max((F.col("file") == "tsconfig.json").cast("int"))
    by_repo = marked.groupBy(R).agg(ts.alias("ts"), F.collect_set("language").alias("l"))
    pos = F.create_map(*[x for lang, k in order.items() for x in (F.lit(lang), F.lit(k))])
    listed = by_repo.select(R, F.explode(F.filter("l", lambda x: ~((x == "javascript") & (F.col("ts") == 1)))).alias("language")).withColumn("p", pos[F.col("language")])
    # a checkout has at most five languages
    ranked = listed.groupBy(R).agg(F.array_sort(F.collect_list(F.struct("p", "language"))).alias("a")).select(R, F.posexplode("a").alias("k", "v")).select(R, F.col("v.language").alias("language"), (F.col("k") + 1).alias("rank"), F.lit("marker").alias("by"))
    parts = F.split("file", "/")
    hidden = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.startswith(p, F.lit(".")) | p.isin("vendor", "node_modules", "__pycache__"))
    counted = files.where(~hidden).select(R, "file").distinct().select(R, language_of_file("file").alias("language")).where("language is not null").groupBy(R, "language").agg(F.count(F.lit(1)).alias("n")).withColumn("p", pos[F.col("language")])
    first = counted.groupBy(R).agg(F.min_by("language", F.struct(-F.col("n"), F.col("p"))).alias("language"))
    none = first.join(ranked.select(F.col(R).alias("_r")).distinct(), F.col(R) == F.col("_r"), "left_anti")
    return ranked.unionByName(none.select(R, "language", F.lit(1).alias("rank"), F.lit("count").alias("by")))


def language_counts(files: DataFrame) -> DataFrame:
    """Files per checkout and language, by ending."""
    return files.select(R, "file").distinct().select(R, language_of_file("file").alias("language")).where("language is not null").groupBy(R, "language").agg(F.count(F.lit(1)).alias("n_files"))


# --- git (driver) ----------------------------------------------------------------------------------------------

def _git(repo: str, *args: str, timeout: float = 5.0) -> str | None:
    try:
        out = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return out.stdout.strip() if out.returncode == 0 else None


def is_repo(path: str) -> bool:
    return _git(path, "rev-parse", "--is-inside-work-tree") == "true"


def head_commit(path: str, timeout: float = 5.0) -> str | None:
    return _git(path, "rev-parse", "HEAD", timeout=timeout)


def changed_files(spark: SparkSession, path: str, since: str) -> DataFrame:
    """(repo_path, file) of files that differ between a commit and HEAD."""
    names = (_git(path, "diff", "--name-only", f"{since}..HEAD", timeout=60) or "").split("\n")
    return spark.createDataFrame([(path, n) for n in names if n], f"{R} string, file string")


def freshness(path: str, last_commit: str | None) -> str:
    """missing (folder gone), unknown (no git answer or never built), current or stale."""
    if not os.path.isdir(path):
        return "missing"
    head = head_commit(path)
    if not head or not last_commit:
        return "unknown"
    return "current" if head == last_commit else "stale"


def read_applied(spark: SparkSession, path: str) -> DataFrame:
    """Delivered summaries: a JSON array of {id, hash, summary}."""
    return spark.read.schema("id string, hash string, summary string").option("multiLine", "true").json(path)


def read_sqlite(spark: SparkSession, path: str, repo: str) -> dict[str, DataFrame]:
    """Tables of one stored SQLite graph with ``repo_path`` in front, read only. The confidence column may be missing."""
    import sqlite3

    out = {}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        for name in ("nodes", "edges", "summaries", "build_meta"):
            cur = con.execute(f"SELECT * FROM {name}")
            names = [c[0] for c in cur.description]
            rows = [tuple(r) for r in cur.fetchall()]
            own = [n for n in names if n != R]
            kinds = {"line_start": T.IntegerType(), "line_end": T.IntegerType(), "stale": T.IntegerType(), "updated_at": T.LongType(), "last_build_at": T.LongType()}
            schema = T.StructType([T.StructField(R, T.StringType()), *[T.StructField(n, kinds.get(n, T.StringType())) for n in own]])
            keep = [names.index(n) for n in own]
            df = spark.createDataFrame([(repo, *[r[k] for k in keep]) for r in rows], schema)
            out[name] = df.withColumn("confidence", F.lit("EXTRACTED")) if name == "edges" and "confidence" not in own else df
    return out
