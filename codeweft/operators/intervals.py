"""Incremental processing over sequence numbers kept as disjoint intervals.

A ledger row says: of stream ``key`` everything from ``lo`` to ``hi`` has been processed. The next run takes the
sequence numbers that are there, subtracts the ledger, processes the gaps (records that arrived late included, since
a gap stays a gap until it is filled) and publishes output and merged ledger in one step.

Streams are cut into blocks of ``BLOCK`` sequence numbers. All windows run per (key, block), so a stream that holds
most of the records is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 4096


def to_intervals(records: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Disjoint maximal intervals (keys, block, lo, hi) covering the sequence numbers, none crossing a block.

    Null sequence numbers are left out. Repeated numbers count once; an empty input gives no interval.
    """
    points = (
        records.where(F.col(seq).isNotNull())
        .select(*keys, F.col(seq).cast("long").alias("_s"))
        .withColumn("block", F.floor(F.col("_s") / BLOCK).cast("long"))
        .distinct()
    )
    w = Window.partitionBy(*keys, "block").orderBy("_s")
    return (
        points.withColumn("_island", F.col("_s") - F.row_number().over(w))
        .groupBy(*keys, "block", "_island")
        .agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
        .drop("_island")
    )


def cut_to_blocks(intervals: DataFrame, keys: Sequence[str], within: DataFrame) -> DataFrame:
    """Clip ledger intervals of any length to the blocks in which there are records (``within``: keys, block).

    Only blocks that occur are made, so an interval over an unbounded range costs nothing.
    """
    blocks = within.select(*keys, "block").distinct()
    lo, hi = F.col("block") * BLOCK, F.col("block") * BLOCK + (BLOCK - 1)
    return (
        blocks.join(intervals.select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), list(keys))
        .where((F.col("_lo") <= hi) & (F.col("_hi") >= lo))
        .select(*keys, "block", F.greatest("_lo", lo).alias("lo"), F.least("_hi", hi).alias("hi"))
    )


def subtract(available: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """available minus processed, both (keys, block, lo, hi): the gaps still to be worked off.

    Sweep over interval ends: available counts 1, processed 1 in another sum; a stretch between two neighbouring
    ends is a gap where the first sum is positive and the second zero.
    """
    def ends(df: DataFrame, a: int, p: int) -> DataFrame:
        return df.select(
            *keys,
            "block",
            F.explode(F.array(
                F.struct(F.col("lo").alias("at"), F.lit(a).alias("a"), F.lit(p).alias("p")),
                F.struct((F.col("hi") + 1).alias("at"), F.lit(-a).alias("a"), F.lit(-p).alias("p")),
            )).alias("e"),
        ).select(*keys, "block", "e.*")

    events = ends(available, 1, 0).unionByName(ends(processed, 0, 1)).groupBy(*keys, "block", "at").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    w = Window.partitionBy(*keys, "block").orderBy("at")
    return (
        events.select(*keys, "block", F.col("at").alias("lo"), (F.lead("at").over(w) - 1).alias("hi"), F.sum("a").over(w).alias("_a"), F.sum("p").over(w).alias("_p"))
        .where((F.col("_a") > 0) & (F.col("_p") <= 0))
        .drop("_a", "_p")
    )


def merge(ledgers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of intervals (keys, lo, hi) as disjoint maximal ones; touching intervals grow together."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    seen = ledgers.select(*keys, "lo", "hi", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    runs = seen.withColumn("_run", F.sum(F.when(F.col("lo") <= F.col("_before") + 1, 0).otherwise(1)).over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def pending(records: DataFrame, ledger: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Rows of ``records`` whose sequence number lies in no ledger interval of their stream.

    ``ledger`` has (keys, lo, hi); intervals may overlap. Rows with a null key or sequence number can't be matched to
    the ledger and are left out; repeated rows stay repeated; an empty ledger leaves every row pending. Extra columns
    pass through; columns named ``block``, ``lo`` and ``hi`` in the records are kept as they are.
    """
    available = to_intervals(records, keys, seq)
    gaps = subtract(available, cut_to_blocks(ledger, keys, available), keys)
    g = gaps.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("block").alias("_g_block"), F.col("lo").alias("_g_lo"), F.col("hi").alias("_g_hi"))
    on = [F.col(k) == F.col(f"_g_{k}") for k in keys]
    at = F.col(seq).cast("long")
    on += [F.floor(at / BLOCK).cast("long") == F.col("_g_block"), at >= F.col("_g_lo"), at <= F.col("_g_hi")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return records.join(g, cond, "left_semi")


class IncrementalRun:
    """Exactly-once incremental runs over a folder: ``current.json`` names the ledger and the outputs that count.

    Output and ledger of a run are written to new folders first; the rename of ``current.json`` publishes both at
    once. A run that dies before leaves ``current.json`` as it was, so the next one neither skips nor repeats records.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], seq: str) -> None:
        self.spark, self.folder, self.keys, self.seq = spark, folder, list(keys), seq

    def _state(self) -> dict:
        try:
            with open(os.path.join(self.folder, "current.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"ledger": None, "outputs": []}

    def ledger(self, like: DataFrame) -> DataFrame:
        at = self._state()["ledger"]
        if at:
            return self.spark.read.parquet(os.path.join(self.folder, at))
        return like.select(*self.keys, F.lit(0).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi")).limit(0)

    def output(self) -> DataFrame | None:
        parts = [os.path.join(self.folder, p) for p in self._state()["outputs"]]
        return self.spark.read.parquet(*parts) if parts else None

    def run(self, records: DataFrame, work: Callable[[DataFrame], DataFrame], before_publish: Callable[[], None] | None = None) -> int:
        """Process what is pending through ``work``; the number of records processed. ``before_publish`` is a test hook."""
        os.makedirs(self.folder, exist_ok=True)
        state, run = self._state(), uuid.uuid4().hex
        todo_at = os.path.join(self.folder, f"todo-{run}")
        pending(records, self.ledger(records), self.keys, self.seq).write.parquet(todo_at)
        todo = self.spark.read.parquet(todo_at)  # fixed, so output and ledger see the same records
        out, led = f"out-{run}", f"ledger-{run}"
        work(todo).write.parquet(os.path.join(self.folder, out))
        done = to_intervals(todo, self.keys, self.seq).select(*self.keys, "lo", "hi")
        merge(self.ledger(records).unionByName(done), self.keys).write.parquet(os.path.join(self.folder, led))
        if before_publish:
            before_publish()
        tmp = os.path.join(self.folder, f".current-{run}")
        with open(tmp, "w") as f:
            json.dump({"ledger": led, "outputs": [*state["outputs"], out]}, f)
        os.replace(tmp, os.path.join(self.folder, "current.json"))
        return todo.count()
