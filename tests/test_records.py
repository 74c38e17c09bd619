"""Intervals, dense sums, snapshot changes, orphans: against brute force, with nulls, ties, copies and empty tables."""

import random
from datetime import UTC, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeweft.operators import intervals
from codeweft.operators.dense_counts import dense_sums
from codeweft.operators.orphans import lasting_cascade, orphan_cascade
from codeweft.operators.pending_work import pending_work
from codeweft.operators.snapshot_diff import Bitmap, extend_ordinals, snapshot_changes
from codeweft.model import EDGES, NODES, SUMMARIES

COMMITS = "repo_path string, commit_no int, commit_hash string, committed_at timestamp, file string, change string"
META = "repo_path string, last_commit string, last_build_at bigint"
NS = "snapshot_no int, repo_path string, id string, hash string, clash string"
ES = "snapshot_no int, repo_path string, id string, confidence string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def at(*a):
    return datetime(*a, tzinfo=UTC)


def test_pending_takes_exactly_what_no_interval_covers(spark):
    rnd = random.Random(5)
    data = [("a" if rnd.random() < 0.9 else None, rnd.randrange(-3, 20_000), k) for k in range(3000)] + [("a", None, -1), ("b", 7, -2), ("b", 7, -3)]
    ledger = [("a", -10, 50), ("a", 40, 5000), ("a", 9000, 9000), ("a", 9001, 12_000), ("c", 0, 10)]
    got = {r.block for r in intervals.pending(spark.createDataFrame(data, "k string, s int, block int"), spark.createDataFrame(ledger, "k string, lo bigint, hi bigint"), ["k"], "s").collect()}
    assert got == {b for k, s, b in data if k and s is not None and not any(k == x and lo <= s <= hi for x, lo, hi in ledger)}


def test_interval_algebra(spark):
    pts = [("x", v) for v in (1, 2, 3, 7, 8, 4095, 4096, 4097, 3)]
    iv = intervals.to_intervals(spark.createDataFrame(pts, "k string, s int"), ["k"], "s")
    assert rows(iv.select("lo", "hi")) == [(1, 3), (7, 8), (4095, 4095), (4096, 4097)]
    merged = intervals.merge(iv.select("k", "lo", "hi"), ["k"])
    assert rows(merged.select("lo", "hi")) == [(1, 3), (7, 8), (4095, 4097)]
    empty = spark.createDataFrame([], "k string, s int")
    assert intervals.to_intervals(empty, ["k"], "s").count() == 0


def test_incremental_run_neither_skips_nor_repeats(spark, tmp_path):
    run = intervals.IncrementalRun(spark, str(tmp_path / "run"), ["k"], "s")
    first = [("a", 1, "x"), ("a", 2, "x"), ("a", 5, "x")]
    df = lambda r: spark.createDataFrame(r, "k string, s int, v string")
    work = lambda d: d.withColumn("v", F.upper("v"))
    assert run.run(df(first), work) == 3

    def die():
        raise RuntimeError("lost before publishing")

    late = [*first, ("a", 3, "late"), ("a", 6, "x"), ("b", 1, "x")]
    with pytest.raises(RuntimeError):
        run.run(df(late), work, die)
    assert rows(run.output().select("k", "s")) == [("a", 1), ("a", 2), ("a", 5)]
    assert run.run(df(late), work) == 3
    assert run.run(df(late), work) == 0
    assert rows(run.output().select("k", "s")) == [("a", 1), ("a", 2), ("a", 3), ("a", 5), ("a", 6), ("b", 1)]
    assert rows(run.ledger(df(late)).select("k", "lo", "hi")) == [("a", 1, 3), ("a", 5, 6), ("b", 1, 1)]


def test_pending_work_cases(spark):
    n = [
        ("r", "f()", "Function", "a.go", 1, 2, None, "old", None, 10), ("r", "f()", "Function", "a.go", 1, 2, None, "new", None, 20), ("r", "f()", "Function", "a.go", 1, 2, None, "new", None, 20),
        ("r", "g()", "Function", "b.go", None, None, None, "h", None, 10), ("r", "h()", "Function", "gone.go", 1, 2, None, "h", None, 10), ("r", "t", "Table", None, None, None, None, None, None, 10),
        ("r", "fld", "Field", "a.go", 1, 1, None, "h", None, 10), ("q", "f()", "Function", "a.go", 1, 2, None, "new", None, 20),
    ]
    s = [("r", "f()", "node", "old", "s", "m", 0), ("r", "f()", "node", "new", "s", "m", 1), ("r", "g()", "node", "h", None, None, 0), ("r", "g()", "node", "h", None, None, 0), ("q", "f()", "file", "new", "s", "m", 0), ("r", "t", "node", None, "s", "m", 0)]
    c = [("r", 1, "abcdef", at(2020, 1, 1), "a.go", "A"), ("r", 2, "bcdefa", at(2019, 1, 1), "b.go", "M"), ("r", 2, "bcdefa", at(2019, 1, 1), "b.go", "M"), ("r", 3, "cdefab", at(2020, 1, 1), "gone.go", "D"), ("r", 3, "cdefab", at(2020, 1, 1), None, "A"), ("q", 1, "aa", at(2020, 1, 1), "a.go", "A"), ("z", 9, "zz", at(2020, 1, 1), "z.go", "A")]
    m = [("r", "abc", 5), ("r", "cdefab", 4), ("q", " ", 1), ("z", "unknown", 1)]
    got = rows(pending_work(spark.createDataFrame(n, NODES), spark.createDataFrame(s, SUMMARIES), spark.createDataFrame(m, META), spark.createDataFrame(c, COMMITS)))
    assert got == [("file", "q", "a.go"), ("file", "r", "b.go"), ("file", "r", "gone.go"), ("file", "z", "z.go"), ("node", "q", "f()"), ("node", "r", "f()"), ("node", "r", "t")]
    empty = pending_work(spark.createDataFrame([], NODES), spark.createDataFrame([], SUMMARIES), spark.createDataFrame([], META), spark.createDataFrame([], COMMITS))
    assert empty.count() == 0


def test_dense_sums_equal_group_by_on_a_crowded_key(spark):
    df = spark.range(0, 200_000, numPartitions=5).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 997 == 0, None).otherwise(F.concat(F.lit("k\x1fü"), F.col("id") % 5000)).alias("k"), (F.col("id") % 7).alias("w"))
    want = {r.k: (r.n, r.w) for r in df.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    assert {r.key: r.total for r in dense_sums(df, F.col("k")).collect()} == {k: v[0] for k, v in want.items()}
    assert {r.key: r.total for r in dense_sums(df, F.col("k"), F.col("w")).collect()} == {k: v[1] for k, v in want.items()}
    assert dense_sums(df.limit(0), F.col("k")).count() == 0
    null_weight = spark.createDataFrame([("a", None), ("a", 2)], "k string, w bigint")
    assert rows(dense_sums(null_weight, F.col("k"), F.col("w"))) == [("a", 2)]


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 300_000), max_size=60), st.sets(st.integers(0, 300_000), max_size=60), st.integers(0, 70_000))
def test_bitmap_set_algebra(a, b, dense):
    a, b = a | set(range(dense)), b | set(range(dense // 2, dense))
    x, y = Bitmap.of(np.array(sorted(a), np.int64)), Bitmap.of(np.array(sorted(b), np.int64))
    assert set(x.and_not(y).ordinals()) == a - b
    assert set((x & y).ordinals()) == a & b
    assert len(x) == len(a)
    assert set(Bitmap.load(x.dump()).ordinals()) == a


def test_ordinals_persist():
    import pandas as pd

    first = extend_ordinals(pd.DataFrame({"id": np.empty(0, object), "ordinal": np.empty(0, np.int64)}), np.array(["b", "a", "b"], object))
    second = extend_ordinals(first, np.array(["c", "a", "0"], object))
    assert dict(zip(second["id"], second["ordinal"])) == {"a": 0, "b": 1, "0": 2, "c": 3}


def test_snapshot_changes_against_brute_force(spark):
    rnd = random.Random(1)
    n, e = [], []
    for no in (1, 2, 4, 5):
        for repo in ("big", "s1", "s2", "s3"):
            if repo == "s2" and no == 2:
                continue
            for k in range(400 if repo == "big" else 5):
                if rnd.random() < 0.8:
                    h = rnd.choice(["aB", "Ab", "cc", None])
                    n += [(no, repo, f"n{k}", h, "x")] * rnd.choice([1, 1, 2])
                if rnd.random() < 0.7 and not (repo == "s3" and no == 4):
                    e.append((no, repo, f"e{k}", None))
    n += [(None, "big", "z", "h", ""), (1, None, "z", "h", ""), (1, "big", None, "h", "")]
    got = rows(snapshot_changes(spark.createDataFrame(n, NS), spark.createDataFrame(e, ES)))
    held, want = {}, set()
    for no, repo, i, h, _ in n:
        if no and repo and i:
            held.setdefault(("nodes", repo, no), {})[i] = (h or "\0").lower()
            held.setdefault(("edges", repo, no), {})
    for no, repo, i, _ in e:
        held[("edges", repo, no)][i] = ""
    for tab in ("nodes", "edges"):
        for repo in ("big", "s1", "s2", "s3"):
            nos = sorted(x for t, r, x in held if t == tab and r == repo)
            for a, b in zip(nos, nos[1:]):
                old, new = held[tab, repo, a], held[tab, repo, b]
                want |= {(tab, repo, i, b, "added") for i in new.keys() - old.keys()} | {(tab, repo, i, b, "removed") for i in old.keys() - new.keys()}
                want |= {(tab, repo, i, b, "changed") for i in new.keys() & old.keys() if new[i] != old[i]}
    assert got == sorted(want)
    assert snapshot_changes(spark.createDataFrame([], NS), spark.createDataFrame([], ES)).count() == 0


def edge(repo, kind, src, dst, when):
    return (repo, f"{kind}|{src}|{dst}", kind, src, dst, None, None, when)


def node(repo, id, updated, file=None, kind="Function"):
    return (repo, id, kind, file, None, None, None, "h", None, updated)


def test_orphans_by_month_and_cascade(spark):
    day = lambda y, m, d: int(at(y, m, d).timestamp())
    n = [node("r", "a", day(2025, 1, 5)), node("r", "m", day(2025, 1, 5)), node("r", "late", day(2025, 3, 1)), node("r", "gone", day(2025, 1, 1), "g.go"), node("r", "back", day(2025, 1, 1), "g.go"), node("r", "back", day(2025, 3, 3), "g.go"), node("x", "missing", day(2025, 1, 1)), node("r", "leaf", day(2025, 1, 1))]
    c = [("r", 1, "h", at(2025, 2, 10), "g.go", "D"), ("r", 2, "h", at(2025, 1, 1), "g.go", "D"), ("r", 3, "h", at(2025, 2, 1), None, "D")]
    jan, feb, mar = at(2025, 1, 31, 23), at(2025, 2, 1), at(2025, 3, 31)
    e = [
        edge("r", "calls", "a", "missing", jan), edge("r", "calls", "a", "missing", jan), edge("r", "calls", "a", "late", feb), edge("r", "calls", "a", "late", mar), edge("r", "calls", "gone", "a", jan), edge("r", "calls", "gone", "a", feb),
        edge("r", "calls", "back", "a", feb), edge("r", "calls", "back", "a", mar), edge("r", "has_method", "missing", "m", jan), edge("r", "calls", "a", "m", jan), edge("r", "has_field", "m", "leaf", jan), edge("r", "calls", None, "a", jan), edge("r", "calls", "a", "a", None),
    ]
    out = rows(orphan_cascade(spark.createDataFrame(e, EDGES), spark.createDataFrame(n, NODES), spark.createDataFrame(c, COMMITS)))
    direct = {r[1:4] for r in out if r[4] == "direct"}
    assert direct == {
        ("calls|a|missing", "dst_id", "2025-01"), ("calls|a|late", "dst_id", "2025-02"), ("calls|gone|a", "src_id", "2025-02"), ("calls|back|a", "src_id", "2025-02"), ("has_method|missing|m", "src_id", "2025-01"),
    }
    assert {r[1:4] + (r[5],) for r in out if r[4] == "inherited"} == {
        ("has_method|missing|m", "dst_id", "2025-01", 1), ("calls|a|m", "dst_id", "2025-01", 1), ("has_field|m|leaf", "src_id", "2025-01", 1), ("has_field|m|leaf", "dst_id", "2025-01", 2),
    }
    none = orphan_cascade(spark.createDataFrame([], EDGES), spark.createDataFrame(n, NODES), spark.createDataFrame(c, COMMITS))
    assert none.count() == 0
    all_direct = orphan_cascade(spark.createDataFrame(e[:1], EDGES), spark.createDataFrame([], NODES), spark.createDataFrame([], COMMITS))
    assert rows(all_direct.groupBy("kind").count()) == [("direct", 2)]


def test_orphaned_state_lasts_over_months(spark):
    day = lambda y, m, d: int(at(y, m, d).timestamp())
    n = [node("r", x, day(2025, 1, 1)) for x in ("a", "m", "leaf", "k")] + [node("r", "back", day(2025, 4, 2))]
    jan, feb, mar, apr = [at(2025, k, 10) for k in (1, 2, 3, 4)]
    e = [
        edge("r", "has_method", "missing", "m", feb), edge("r", "calls", "a", "m", jan), edge("r", "has_field", "m", "leaf", mar), edge("r", "calls", "a", "leaf", feb), edge("r", "reads", "a", "leaf", apr),
        edge("r", "has_method", "back", "k", jan), edge("r", "calls", "a", "k", mar), edge("r", "reads", "a", "k", apr), edge("r", "has_field", "leaf", "m", apr),
    ]
    frames = spark.createDataFrame(e, EDGES), spark.createDataFrame(n, NODES), spark.createDataFrame([], COMMITS)
    out = {r[1:4] + (r[5],) for r in rows(lasting_cascade(*frames))}
    assert out == {
        ("has_method|missing|m", "src_id", "2025-02", 0), ("has_method|missing|m", "dst_id", "2025-02", 1), ("has_field|m|leaf", "src_id", "2025-03", 1), ("has_field|m|leaf", "dst_id", "2025-03", 2),
        ("reads|a|leaf", "dst_id", "2025-04", 2), ("has_field|leaf|m", "src_id", "2025-04", 2), ("has_field|leaf|m", "dst_id", "2025-04", 1),
        ("has_method|back|k", "src_id", "2025-01", 0), ("has_method|back|k", "dst_id", "2025-01", 1), ("calls|a|k", "dst_id", "2025-03", 1),
    }
    assert {r[1:4] for r in rows(orphan_cascade(*frames))} < {x[:3] for x in out}
