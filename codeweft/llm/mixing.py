"""Mixing sources to target shares of a total size.

Each document gets a weighted exponential key, ``-ln(u) / weight``, its weight being its share of running text; ascending keys are a weighted random order without
replacement. A source whose budget exceeds its size is taken whole as often as it fits, then the documents first in
order fill the rest. Running sums are formed within range partitions of (source, key) and carried over by the
partitions' totals, so a source holding most documents is spread like any other.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.text_quality import prose_share
from codeweft.runtime import cut, shuffle_partitions, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Weight of a document without running text; one that is all running text has 1.
LEAST_WEIGHT = 0.1
#: The pieces into which a byte-level tokenizer cuts a text in ASCII; merges stay inside a piece, so it has as many tokens wherever it stands.
_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Characters taken at once, pieces kept at once and their greatest length, and the characters for each new piece below which whole texts cost less.
CHUNK, KEPT, LONG, FEW = 1 << 18, 200_000, 64, 20


def canonical_source(c: Column | str) -> Column:
    """Spelling in lower case with single underscores; blank as null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), r"[^\p{L}\p{N}]+", "_"), F.lit("_")), F.lit(""))


def by_pieces(tokenizer: bytes) -> bool:
    """Whether a tokenizer file cuts texts as ``_PIECE`` does and nothing before or after changes them."""
    t = json.loads(tokenizer)
    cuts = t.get("pre_tokenizer") or {}
    return (
        cuts.get("type") == "ByteLevel" and not cuts.get("add_prefix_space") and cuts.get("use_regex", True) and t["model"].get("type") == "BPE" and not t["model"].get("dropout")
        and not any(t.get(k) for k in ("normalizer", "truncation", "padding")) and all(x["special"] for x in t.get("added_tokens") or ())
    )


class TokenCounter:
    """Tokens of texts. With ``pieces``, a piece met before is not tokenized again; other than ASCII goes to the tokenizer whole."""

    def __init__(self, tokenizer: bytes, pieces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces, self.known = Tokenizer.from_buffer(tokenizer), pieces, {}
        self.tokenizer.encode_special_tokens = True

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    def _chunk(self, texts: list[str]) -> list[int]:
        cuts = [_PIECE.findall(x) if self.pieces and x.isascii() else None for x in texts]
        own = set().union(*filter(None, cuts))
        new = list(own.difference(self.known))
        if len(new) * FEW > sum(map(len, texts)):
            return self.encoded(texts)
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(own)
        self.known.update(zip(new, self.encoded(new)))
        rest = iter(self.encoded([x for x, c in zip(texts, cuts) if c is None]))
        out = [next(rest) if c is None else sum(map(self.known.__getitem__, c)) for c in cuts]
        for x in new:
            if len(x) > LONG:
                del self.known[x]
        return out

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        begin = held = 0
        for k, x in enumerate(texts, 1):
            held += len(x)
            if held >= CHUNK or k == len(texts):
                out += self._chunk(texts[begin:k])
                begin, held = k, 0
        return out


def _size(tokenizer, pieces: bool):
    """Tokens and quality of each text, both from the one time it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(tokenizer.value, pieces)
        for b in batches:
            texts = [x or "" for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "mark": b["mark"], "tokens": counter.count(texts), "weight": [quality_weight(x) for x in texts]})

    return run


def quality_weight(text: str | None) -> float:
    """Share of a text's characters in running sentences, as ``text_quality`` finds it, and never less than ``LEAST_WEIGHT``."""
    return max(LEAST_WEIGHT, prose_share(text or ""))


def sized(documents: DataFrame, tokenizer_path: str = TOKENIZER, seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, weight, key) of every document with an id, a source and at least one token, each once.

    Where rows of one doc_id differ, the one with the least fingerprint of source and text stands.
    """
    with open(tokenizer_path, "rb") as f:
        held = f.read()
    tokenizer = documents.sparkSession.sparkContext.broadcast(held)
    source = canonical_source(F.col("source"))
    rows = documents.where(F.col("doc_id").isNotNull() & source.isNotNull()).select("doc_id", source.alias("source"), "text", F.xxhash64(source, "text").alias("mark"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(2**53)
    return (
        spread(rows).mapInPandas(_size(tokenizer, by_pieces(held)), "doc_id bigint, source string, mark bigint, tokens bigint, weight double")
        .where("tokens > 0")
        .groupBy("doc_id").agg(*[F.min_by(c, "mark").alias(c) for c in ("source", "tokens", "weight")])
        .select("doc_id", "source", "tokens", "weight", (-F.log(u) / F.col("weight")).alias("key"))
    )


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> list[dict]:
    """Budgets per target source. Shares of sources without documents go to the others in proportion.

    Without ``total`` the mix is the largest in which every source that has documents still reaches its share.
    """
    there = sum(share for s, share, cap in targets if sizes.get(s) and cap > 0 and share > 0)
    own = {s: share / there for s, share, cap in targets if sizes.get(s) and cap > 0 and share > 0}
    if total is None:
        total = min((int(sizes[s] * cap / own[s]) for s, _, cap in targets if s in own), default=0)
    out = []
    for s, share, cap in targets:
        size = sizes.get(s, 0)
        budget = min(round(own.get(s, 0.0) * total), size * max(cap, 0))
        epochs, rest = divmod(budget, size) if size else (0, 0)
        out.append({"source": s, "target_share": share, "max_repeats": cap, "available_tokens": size, "budget": budget, "epochs": epochs, "rest": rest})
    return out


PLAN = "source string, target_share double, max_repeats int, available_tokens bigint, budget bigint, epochs bigint, rest bigint"


def _mix(documents: DataFrame, mix_targets: DataFrame, total: int | None, tokenizer_path: str, seed: int) -> tuple[DataFrame, DataFrame]:
    spark = documents.sparkSession
    # The targets are a fixed list; so are the sums per target source.
    targets = [
        (r.source, float(r.target_share or 0), int(r.max_repeats or 0))
        for r in mix_targets.groupBy(canonical_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null").orderBy("source").collect()
    ]
    parts = shuffle_partitions(spark)
    ordered = cut(
        sized(documents, tokenizer_path, seed).where(F.col("source").isin([s for s, _, _ in targets] or [""]))
        .repartitionByRange(parts, "source", "key", "doc_id").withColumn("part", F.spark_partition_id())
    )
    sums = ordered.groupBy("source", "part").agg(F.sum("tokens").alias("sum"))
    sizes = {r.source: r.n for r in sums.groupBy("source").agg(F.sum("sum").alias("n")).collect()}
    planned = spark.createDataFrame([tuple(p.values()) for p in plan(sizes, targets, total)], PLAN)
    offsets = sums.select("source", "part", (F.sum("sum").over(Window.partitionBy("source").orderBy("part")) - F.col("sum")).alias("before"))
    running = F.sum("tokens").over(Window.partitionBy("source", "part").orderBy("key", "doc_id"))
    taken = (
        ordered.withColumn("running", running)
        .join(F.broadcast(offsets), ["source", "part"])  # one row for each range partition and source in it
        .join(F.broadcast(planned.select("source", "epochs", "rest")), "source")
        .select("doc_id", "source", "tokens", (F.col("epochs") + F.when(F.col("before") + F.col("running") <= F.col("rest"), 1).otherwise(0)).cast("int").alias("repeats"))
        .where("repeats > 0")
    )
    return taken, planned


def mix(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, tokenizer_path: str = TOKENIZER, seed: int = 42) -> DataFrame:
    """(doc_id, source, tokens, repeats): how often each chosen document is in the mix, never above its max_repeats.

    Documents of null, blank or untargeted sources, without id or without tokens are not chosen; ties of keys go by
    doc_id; an empty table gives an empty mix. A source misses its budget by less than one document.
    """
    return _mix(documents, mix_targets, total, tokenizer_path, seed)[0]


def shares(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, tokenizer_path: str = TOKENIZER, seed: int = 42) -> DataFrame:
    """Per target source what was planned and what the mix holds: tokens, documents, repeats and the share reached."""
    taken, planned = _mix(documents, mix_targets, total, tokenizer_path, seed)
    got = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("repeats").alias("most_repeats"))
    all_tokens = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # over the fixed list of targets
    return (
        planned.join(got, "source", "left").fillna(0, ["mixed_tokens", "n_documents", "most_repeats"])
        .withColumn("reached_share", F.when(all_tokens > 0, F.col("mixed_tokens") / all_tokens).otherwise(F.lit(0.0)))
        .drop("rest")
    )
