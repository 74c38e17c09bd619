"""Evaluation items inside training documents, found with a generalised suffix automaton.

The items' words form one automaton: every path from its root is a run of words of some item. A document streams
through it word by word; the automaton always knows the longest run ending here that some item holds. Where that length
reaches the limit, the state names the items. Items of more than ``SHARD`` words together are cut into several automata;
they are made one after the other from a stream of items, each is broadcast by itself, and the documents pass each in a
stage of its own, so neither the driver nor a task ever holds more than one. What the stages find is merged by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import spread

#: Consecutive words from which a passage counts.
LEAST_RUN = 12
#: Share of a document's words in leaked spans from which the whole document is dropped.
DROP_SHARE = 0.5
#: Words in one automaton, which is what goes to an executor at once. Measured: 381 bytes a word in memory, so 38 MB.
SHARD = 100_000

WORD = re.compile(r"[A-Za-z0-9]+", re.ASCII)


class SuffixAutomaton:
    """Of several word sequences. States have a longest length, a suffix link and transitions by word number."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.items: list[set[int]] = [set()]
        self._ends: list[tuple[int, list[int]]] = []

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.len.append(length)
        self.items.append(set())
        return len(self.len) - 1

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        cur, p = self._state(length[last] + 1), last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.len[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.items[clone] = set(self.items[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, item: int, words: list[str]) -> None:
        state = 0
        for x in words:
            state = self._extend(state, self.words.setdefault(x, len(self.words)))
        self._ends.append((item, [self.words[x] for x in words]))

    def seal(self) -> SuffixAutomaton:
        """Gives each state the items in which its runs occur, from prefixes up the suffix links."""
        for item, words in self._ends:
            state = 0
            for w in words:
                state = self.next[state][w]
                s = state
                while s > 0 and item not in self.items[s]:
                    self.items[s].add(item)
                    s = self.link[s]
        del self._ends
        self.items = [tuple(sorted(x)) if n >= self.least else () for x, n in zip(self.items, self.len)]
        return self

    def holders(self, state: int, run: int) -> Iterator[tuple[int, int]]:
        """(item, words of the run that it holds) for a run ending in a state: longer runs first, then their endings."""
        while state > 0 and run >= self.least:
            for i in self.items[state]:
                yield i, run
            state = self.link[state]
            run = self.len[state]

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(last word, length, state) wherever a run of at least ``least`` words of some item ends."""
        number, nxt, link, length, least = self.words.get, self.next, self.link, self.len, self.least
        state = run = 0
        for k, x in enumerate(words):
            w = number(x, -1)
            if w < 0:
                state = run = 0
                continue
            while state and w not in nxt[state]:
                state = link[state]
                run = length[state]
            if w in nxt[state]:
                state, run = nxt[state][w], run + 1
            if run >= least:
                yield k, run, state


def build(items: Iterable[tuple[int, str]], least: int = LEAST_RUN) -> Iterator[SuffixAutomaton]:
    """Automata over items one by one, each of at most ``SHARD`` words (one item more where it alone is longer)."""
    current, room = None, 0
    for item, text in items:
        words = [x.lower() for x in WORD.findall(text or "")]
        if len(words) < least:
            continue
        if current is None or room < len(words):
            if current is not None:
                yield current.seal()
            current, room = SuffixAutomaton(least), SHARD
        current.add(item, words)
        room -= len(words)
    if current is not None:
        yield current.seal()


FOUND = "n_words int, spans array<struct<s:int,e:int>>, items array<struct<item_id:bigint,longest:int,start_char:int,end_char:int>>"


def found(text: str, automaton: SuffixAutomaton) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """(number of words, character spans that are leaked, for each item its longest run and where it stands)."""
    at = list(WORD.finditer(text))
    best: dict[int, tuple[int, int, int]] = {}
    spans: list[tuple[int, int]] = []
    for k, run, state in automaton.spans([m.group().lower() for m in at]):
        first = k - run + 1
        while spans and spans[-1][1] >= first - 1:  # ends only grow; a longer run swallows what lies in it
            first = min(first, spans.pop()[0])
        spans.append((first, k))
        for i, held in automaton.holders(state, run):
            if i not in best or held > best[i][0]:
                best[i] = (held, k - held + 1, k)
    return len(at), [(at[s].start(), at[e].end()) for s, e in spans], [(i, r, at[s].start(), at[e].end()) for i, (r, s, e) in sorted(best.items())]


def _matching(automaton, keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, text in zip(*[b[k] for k in keys], b["text"]):
                n, spans, items = found(text, automaton.value)
                if items:
                    rows.append((*key, n, [{"s": s, "e": e} for s, e in spans], [dict(zip(("item_id", "longest", "start_char", "end_char"), x)) for x in items]))
            yield pd.DataFrame(rows, columns=[*keys, "n_words", "spans", "items"]).astype({"n_words": "int32"} | ({"doc_id": "int64"} if "doc_id" in keys else {}))

    return run


def merge_spans(spans: list) -> list[tuple[int, int]]:
    """Character spans as disjoint ones in order."""
    out: list[list[int]] = []
    for x in sorted((x["s"], x["e"]) for x in spans):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


def cut_out(text: str | None, spans: list | None, drop_share: float) -> tuple[int, int, bool, str | None]:
    """(words, leaked words, dropped, text without the spans)."""
    if text is None:
        return 0, 0, False, None
    n = sum(1 for _ in WORD.finditer(text))
    if spans is None or not len(spans):
        return n, 0, False, text
    parts, last, leaked = [], 0, 0
    for s, e in merge_spans(spans):
        parts.append(text[last:s])
        leaked += sum(1 for _ in WORD.finditer(text, s, e))
        last = e
    dropped = leaked / n > drop_share
    return n, leaked, dropped, None if dropped else "".join([*parts, text[last:]])


CLEAN = "doc_id string, n_words int, leaked_words int, dropped boolean, text string"


def _cleaning(automaton, drop_share: float):
    """With one automaton texts are matched and cut in one go; without, their spans come in a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if automaton is not None:
                spans = [None if t is None else [{"s": s, "e": e} for s, e in found(t, automaton.value)[1]] for t in b["text"]]
            else:
                spans = b["spans"]
            rows = [(doc, *cut_out(t, x, drop_share)) for doc, t, x in zip(b["doc_id"], b["text"], spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "leaked_words", "dropped", "text"]).astype({"n_words": "int32", "leaked_words": "int32", "dropped": bool, "text": object})

    return run


def _automata(eval_items: DataFrame, least: int) -> list:
    """Broadcast automata. Items come to the driver as a stream, one of its automata at a time."""
    rows = eval_items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    context, out = eval_items.sparkSession.sparkContext, []
    for a in build(((r.item_id, r.text) for r in rows.toLocalIterator()), least):
        b = context.broadcast(a)
        b.unpersist()  # the driver keeps the pickled form on disk, executors fetch it when their stage runs
        out.append(b)
    return out or [context.broadcast(SuffixAutomaton(least).seal())]


def _all_found(rows: DataFrame, keys: list[str], automata: list) -> DataFrame:
    """(keys, n_words, spans, items) of affected rows. One automaton: no shuffle; more: only what was found is merged."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " + FOUND
    parts = [spread(rows).mapInPandas(_matching(a, keys), schema) for a in automata]
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a row that is there twice brings the same spans and items again
    return out.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def leaks(documents: DataFrame, eval_items: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """Affected documents: doc_id, n_words, leaked_words, items (item, longest run seen, where it stands).

    Null or empty texts and ids, and items shorter than ``least`` words, give nothing; whole texts are read; a row that
    is there twice counts once. The documents never move, only what is found in them does.
    """

    @F.pandas_udf("int")
    def leaked(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_out(t, s, 1.0)[1] for t, s in zip(text, spans)], dtype="int32")

    # affected texts go along, since spans of several automata overlap
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    automata = _automata(eval_items, least)
    return _all_found(docs, ["doc_id", "text"], automata).select("doc_id", "n_words", leaked("text", "spans").alias("leaked_words"), "items").distinct()


def leak_pairs(documents: DataFrame, eval_items: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """(doc_id, item_id), each once."""
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    automata = _automata(eval_items, least)
    found_in = [spread(docs).mapInPandas(_matching(a, ["doc_id"]), "doc_id bigint, " + FOUND).select("doc_id", F.explode("items.item_id").alias("item_id")) for a in automata]
    out = found_in[0]
    for p in found_in[1:]:
        out = out.unionByName(p)
    return out.distinct()


def remove_leaks(documents: DataFrame, eval_items: DataFrame, least: int = LEAST_RUN, drop_share: float = DROP_SHARE) -> DataFrame:
    """Every document row with its leaked spans cut out; ``dropped`` and a null text where they exceed ``drop_share``."""
    automata = _automata(eval_items, least)
    # as text, since a batch with a null would turn whole numbers into floating ones
    rows = documents.select(F.col("doc_id").cast("string"), "text")
    if len(automata) == 1:
        clean = spread(rows).mapInPandas(_cleaning(automata[0], drop_share), CLEAN)
    else:
        # spans are found for each text and joined back to the rows that hold it
        keyed = rows.withColumn("key", F.sha2("text", 256))
        spans = _all_found(keyed.where("text is not null").select("key", "text"), ["key"], automata).select(F.col("key").alias("_k"), "spans")
        clean = keyed.join(spans, F.col("key") == F.col("_k"), "left").select("doc_id", "text", "spans").mapInPandas(_cleaning(None, drop_share), CLEAN)
    return clean.withColumn("doc_id", F.col("doc_id").cast("bigint"))
