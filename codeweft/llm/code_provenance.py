"""Which source files somebody wrote by hand: generated, minified, third-party and data files told from them.

Names are the first evidence. All files of a language train one character trigram model of its identifiers: a file whose
own names cost far more bits than the language's usual ones is mangled (minified); a file that repeats few names over and
over for its length is filled from a template (generated); a file whose naming style lies far from the other files of its
checkout and language came from elsewhere (vendored); a file that has hardly any names beside its literals is data.

Generators and copies that keep the house style show nothing of this. For those the origin stated about the file decides:
in its head comment (never in strings), in the place where it lies, or in the properties recorded for its nodes. The
README gives how many files each part decides.

Every text is read once. That pass writes measures and trigram counts; models, styles and verdicts come from those.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.lexing import language_of, normalise, scan
from codeweft.runtime import cut, spread

LANGUAGES = ("python", "go", "java", "typescript", "javascript")

#: Bits a sign above the language's mean from which names are mangled, and how many names it takes to say so.
MANGLED_BITS, LEAST_NAMES = 1.0, 5
#: Different names over names^0.75 below which names are template-like.
TEMPLATE_DIVERSITY = 1.0
#: Sum of the differences in camel, snake and capital shares to the checkout's other files, and how many those have to be.
FOREIGN_STYLE, LEAST_FILES = 0.8, 8
#: Share of literals in what is no comment, with at most one declaration beside them.
LITERALS = 0.6

# Folder and file names by which tools mark their output.
VENDOR_DIRS = {"vendor", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "site-packages", "dist-packages", "external", "externals", "_vendor", "godeps", "pods", "jspm_packages"}
GENERATED_DIRS = {"gen", "generated", "__generated__", "autogen", "generated-sources", "generated-src", "_generated"}
GENERATED_NAME = re.compile(r"(?:\.pb\.\w+|_pb2(?:_grpc)?\.pyi?|_grpc\.\w+|\.(?:gen|g|generated|designer|pb)\.\w+|_(?:generated|gen|autogen)\.\w+)$|^(?:zz_generated|generated_|autogenerated)", re.I)
MINIFIED_NAME = re.compile(r"[.-]min\.\w+$|\.(?:bundle|chunk)\.js$", re.I)

#: What a tool says of its output: made automatically, made from or by something, not to be edited.
_MADE = re.compile(
    r"@generated\b|\bauto(?:matically)?[ -]?(?:generated|produced|created|written)\b|(?<!not )(?<!never )(?<!n't )\bgenerated (?:by|from|with|using|on)\b"
    r"|\bdo not (?:edit|modify|change|touch)\b|\b(?:edits|changes|modifications)\b[^.;]*\b(?:lost|overwritten|discarded|replaced)\b",
    re.I,
)
#: What a copy says of itself: whose it is, and that it came from there.
_BROUGHT = re.compile(r"\bupstream\b|\bcop(?:y|ied) (?:verbatim )?(?:of|from)\b|\bvendored\b|\bthird[- ]party\b|\bfork of\b|\b(?:under|see) (?:the )?(?:terms|its|licen[cs]e)\b|\blicen[cs]ed\b|https?://", re.I)
#: A product with the number of its version. Whoever writes by hand does not put one on top of a file.
_VERSIONED = re.compile(r"\b[A-Za-z][\w./-]*(?:@| +(?:v|release +|version +)?)v?\d+\.\d+(?:\.\d+)*\b")

_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"(?<![\w$])[-+]?(?:0x[\da-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\b")
_DECLARED = re.compile(r"\b(?:func|function|def|class|interface|enum|return)\b|=>\s*\{")
_CAMEL, _DIGIT, _STRANGE = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"\d"), re.compile(r"[^a-z0_$]")
_KEYWORDS = frozenset(
    "if else for while do return break continue switch case default try catch finally throw throws new class interface enum extends implements import export from as package func function def lambda async await yield var let const type struct "
    "public private protected static final void int string bool boolean byte float double long char nil null None undefined true false True False self this super range map chan go defer select in is not and or with pass raise except global nonlocal del print len "
    "String List Optional Override error any number object module exports".split()
)

#: Signs of the models: letters, a digit, marks, anything else, start and end of a name.
SIGNS = "abcdefghijklmnopqrstuvwxyz0_$?^."
_AT = {c: k for k, c in enumerate(SIGNS)}
GRAMS = len(SIGNS) ** 3


def grams(name: str) -> list[int]:
    """Numbers of a name's trigrams; a step from small to capital letter counts as an underscore."""
    s = "^^" + _STRANGE.sub("?", _DIGIT.sub("0", _CAMEL.sub("_", name).lower())) + "."
    k = [_AT[c] for c in s]
    return [(a * 32 + b) * 32 + c for a, b, c in zip(k, k[1:], k[2:])]


def head_comments(text: str, tokens, code: str) -> list[str]:
    """Comment lines before the first code."""
    m = re.search(r"\S", code)
    limit = m.start() if m else len(text)
    return [line for t in tokens if t.kind in ("line", "block", "doc") and t.start < limit for line in text[t.start : t.end].split("\n")]


def stated(head: list[str]) -> str:
    """vendored, generated or nothing: what head comments say. A product's version alone speaks for a tool's output."""
    joined = "\n".join(head)
    versioned = _VERSIONED.search(joined)
    if versioned and _BROUGHT.search(joined):
        return "vendored"
    if _MADE.search(joined) or versioned:
        return "generated"
    return "vendored" if re.search(r"\bvendored from\b|\bcopied (?:verbatim )?from\b|\bthird[- ]party (?:sources?|code|librar)", joined, re.I) else ""


def place(file: str | None) -> str:
    """vendored, generated, minified or nothing: what folders and the file's name say."""
    parts = (file or "").replace("\\", "/").split("/")
    folders, name = {p.lower() for p in parts[:-1]}, parts[-1]
    if folders & VENDOR_DIRS:
        return "vendored"
    if folders & GENERATED_DIRS or GENERATED_NAME.search(name):
        return "generated"
    return "minified" if MINIFIED_NAME.search(name) else ""


MEASURES = (
    "file_id bigint, repo_path string, file string, language string, mark bigint, n_names int, n_distinct int, short_names double, camel_share double, snake_share double, capital_share double, "
    "literal_share double, declared int, stated string, place string, grams array<int>, used array<int>, once array<int>"
)
_COLUMNS = [c.split()[0] for c in MEASURES.split(", ")]
_KNOWN: dict[str, np.ndarray] = {}


def measures(file: str | None, content: str, language: str) -> tuple:
    """Values of ``MEASURES`` from n_names on, for one file."""
    text = normalise(content)
    tokens, code = scan(text, language)
    names = Counter(n for n in _NAME.findall(code) if n not in _KEYWORDS)
    solid = max(1, sum(map(len, text.split())))
    comment = strings = 0
    for t in tokens:
        size = len("".join(text[t.start : t.end].split()))
        if t.kind == "string":
            strings += size
        else:
            comment += size
    numbers = sum(map(len, _NUMBER.findall(code)))
    body = max(1, solid - comment)
    literals = (strings + numbers + 0.5 * (code.count(",") if numbers + strings > 0.3 * body else 0)) / body
    if len(_KNOWN) > 100_000:  # bounds a worker's memory
        _KNOWN.clear()
    parts, sizes = [], []
    for n in names:
        if (g := _KNOWN.get(n)) is None:
            g = _KNOWN[n] = np.array(grams(n), np.int32)
        parts.append(g)
        sizes.append(len(g))
    total, count = sum(names.values()), np.fromiter(names.values(), np.int64, len(names))
    if parts:
        ids, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        used = np.bincount(inverse, np.repeat(count, sizes)).astype(np.int32)
        once = np.bincount(inverse).astype(np.int32)
    else:
        ids = used = once = np.empty(0, np.int32)

    def share(held) -> float:
        return sum(c for n, c in names.items() if held(n)) / total if total else 0.0

    return (
        total, len(names), share(lambda n: len(n) <= 2), share(lambda n: _CAMEL.search(n) is not None), share(lambda n: "_" in n.strip("_")), share(lambda n: n[0].isupper()),
        literals, len(_DECLARED.findall(code)), stated(head_comments(text, tokens, code)), place(file), ids, used, once,
    )


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kinds = {"file_id": "int64", "mark": "int64"} | {c: "int32" for c in ("n_names", "n_distinct", "declared")} | {c: "float64" for c in _COLUMNS if c.endswith(("share", "short_names"))}
    for b in batches:
        rows = []
        for file_id, repo, file, language, content, mark in zip(b["file_id"], b["repo_path"], b["file"], b["language"], b["content"], b["mark"]):
            lang = language_of(file, language)
            rows.append((file_id, repo, file, lang, mark, *measures(file, content, lang if lang in LANGUAGES else "javascript")))
        yield pd.DataFrame(rows, columns=_COLUMNS).astype(kinds)


class NameModel:
    """Character trigrams of one language's names with add-half smoothing over its signs."""

    def __init__(self, n: np.ndarray) -> None:
        context = np.repeat(n.reshape(-1, 32).sum(1), 32)
        self.bits = -np.log2((n + 0.5) / (context + 16))
        total = n.sum()
        self.mean = float((n * self.bits).sum() / total) if total else 0.0

    def cost(self, ids: np.ndarray, used: np.ndarray) -> float:
        """Bits a sign of a file's names, by how often they occur."""
        total = used.sum()
        return float((self.bits[ids] * used).sum() / total) if total else 0.0


def train(measured: DataFrame) -> dict[str, NameModel]:
    """Models from all files, each of which counts each of its names once. At most 5 * 32^3 sums reach the driver."""
    pair = F.explode(F.arrays_zip("grams", "once")).alias("p")
    rows = measured.where(F.col("language").isin(*LANGUAGES)).select("language", pair).groupBy("language", F.col("p.grams").alias("g")).agg(F.sum("p.once").alias("n")).toPandas()
    models = {}
    for lang in LANGUAGES:
        n = np.zeros(GRAMS)
        own = rows[rows["language"] == lang]
        n[own["g"].to_numpy(int)] = own["n"].to_numpy(float)
        models[lang] = NameModel(n)
    return models


def verdict() -> tuple[Column, Column]:
    """(kind, reason) as expressions over one row of measures: names come first, then what is stated of the file."""
    named = F.col("n_names") >= LEAST_NAMES
    rules = [
        (named & (F.col("excess_bits") > MANGLED_BITS), F.lit("minified"), "mangled names"),
        ((F.col("literal_share") > LITERALS) & (F.col("declared") <= 1), F.lit("data"), "literals without names"),
        (named & (F.col("diversity") < TEMPLATE_DIVERSITY), F.lit("generated"), "template-like names"),
        (named & (F.col("other_files") >= LEAST_FILES) & (F.col("foreign_style") > FOREIGN_STYLE), F.lit("vendored"), "foreign style"),
        (F.col("stated") != "", F.col("stated"), "stated in head"),
        (F.col("recorded").isNotNull(), F.col("recorded"), "recorded"),
        (F.col("place") != "", F.col("place"), "place"),
    ]
    kind, reason = F.lit("hand"), F.lit("")
    for holds, then, why in reversed(rules):
        holds = F.coalesce(holds, F.lit(False))
        kind, reason = F.when(holds, then).otherwise(kind), F.when(holds, F.lit(why)).otherwise(reason)
    return kind, reason


SLIM = ", ".join(c for c in MEASURES.split(", ") if "array" not in c) + ", bits double, excess_bits double, diversity double"


def _cost(models):
    """Measures without their trigrams, with bits a sign, bits above the language's mean and diversity."""
    own = [c.split()[0] for c in SLIM.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [models.value.get(x) for x in b["language"]]
            bits = np.array([m.cost(g, u) if m else 0.0 for m, g, u in zip(known, b["grams"], b["used"])])
            yield b.assign(
                bits=bits, excess_bits=bits - np.array([m.mean if m else 0.0 for m in known]),
                diversity=np.where(b["n_names"] > 0, b["n_distinct"] / np.maximum(b["n_names"], 1) ** 0.75, 0.0),
            )[own]

    return run


_RECORDED = "generated boolean, generated_by string, generator string, origin string, vendored boolean"


def recorded_origins(nodes: DataFrame) -> DataFrame:
    """(repo_path, file, recorded): generated or vendored where the newest node of a file that says something about its origin says so."""
    told = F.from_json("properties", _RECORDED).alias("p")
    rows = nodes.where(
        F.col("repo_path").isNotNull() & F.col("file").isNotNull() & F.col("properties").rlike('"(?:generated|generated_by|generator|origin|vendored)"')
    ).select("repo_path", "file", "updated_at", told)

    def given(c: Column) -> Column:
        return c.isNotNull() & ~F.lower(F.trim(c)).isin("", "null", "none", "false", "manual", "hand")

    made = F.coalesce(F.col("p.generated"), F.lit(False)) | given(F.col("p.generated_by")) | given(F.col("p.generator")) | F.coalesce(F.lower("p.origin") == "generated", F.lit(False))
    brought = F.coalesce(F.col("p.vendored"), F.lit(False)) | F.coalesce(F.lower("p.origin").isin("vendored", "third-party", "third_party"), F.lit(False))
    # of two nodes of one time the one that names an origin counts
    order = F.struct(F.coalesce(F.col("updated_at").cast("long"), F.lit(0)).alias("at"), F.when(brought, 2).when(made, 1).otherwise(0).alias("k"))
    newest = rows.select("repo_path", "file", order.alias("o")).groupBy("repo_path", "file").agg(F.max("o.at").alias("_at"), F.max("o").alias("_o"))
    return newest.select("repo_path", "file", F.when(F.col("_o.k") == 2, "vendored").when(F.col("_o.k") == 1, "generated").alias("recorded")).where("recorded is not null")


def measured_files(source_files: DataFrame) -> DataFrame:
    """The measures of every row with a file_id and a content."""
    rows = source_files.where(F.col("file_id").isNotNull() & F.col("content").isNotNull()).select("file_id", "repo_path", "file", "language", "content", F.xxhash64("repo_path", "file", "language", "content").alias("mark"))
    return spread(rows).mapInPandas(_measure, MEASURES)


def code_provenance(source_files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per file with a content: its kind (hand, generated, minified, vendored, data), the reason and the measures.

    ``nodes`` gives the properties recorded for files. Rows without file_id or content are left out; an empty text is
    nobody's output (hand, unless something is stated of it); copies of a row count once, and where rows of one file_id
    differ the one with the least fingerprint stands; an unknown language is judged without a model; extra columns are
    ignored.
    """
    measured = cut(measured_files(source_files))
    models = source_files.sparkSession.sparkContext.broadcast(train(measured))
    files = measured.drop("once").mapInPandas(_cost(models), SLIM)
    # how the checkout's other files of the language write their names, from sums
    style = ["camel_share", "snake_share", "capital_share"]
    house = measured.groupBy(F.col("repo_path").alias("_r"), F.col("language").alias("_l")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in style])
    others = F.col("_n") - 1
    foreign = sum((F.abs(F.col(c) - (F.col(f"_{c}") - F.col(c)) / F.greatest(others, F.lit(1))) for c in style), F.lit(0.0))
    files = files.join(house, F.col("repo_path").eqNullSafe(F.col("_r")) & F.col("language").eqNullSafe(F.col("_l"))).withColumns({"other_files": others, "foreign_style": foreign})
    if nodes is None:
        files = files.withColumn("recorded", F.lit(None).cast("string"))
    else:
        told = recorded_origins(nodes).select(F.col("repo_path").alias("_nr"), F.col("file").alias("_nf"), "recorded")
        files = files.join(told, (F.col("repo_path") == F.col("_nr")) & (F.col("file") == F.col("_nf")), "left")
    kind, reason = verdict()
    one = F.struct(kind.alias("kind"), reason.alias("reason"), *OUT)
    return files.groupBy("file_id").agg(F.min_by(one, "mark").alias("m")).select("file_id", "m.*")


#: Measures given with the verdict.
OUT = ["repo_path", "file", "language", "bits", "excess_bits", "diversity", "foreign_style", "other_files", "short_names", "camel_share", "literal_share"]
