"""Watching a store and streaming increments into it.

A build counter, not the clock, tells versions apart, so two builds within a second are two. A reload that fails is
tried again on the next tick.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeweft.operators.graph import R, PropertyGraph
from codeweft.plans.store import StoreReader
from codeweft.runtime import shared_folder
from codeweft.sources.graph_tables import one_summary

POLL_SECONDS = 2


class Snapshot:
    """Tables of one published version; stays readable while newer ones are written."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        store = StoreReader(spark, folder)
        self.version = store.build_no()
        self.graph: PropertyGraph = store.graph()
        self.summaries: DataFrame = one_summary(store.table("summaries"))
        self.meta = store.state()["meta"]


class Broadcaster:
    """Tells listeners that something changed; a listener that has not looked yet is told once."""

    def __init__(self) -> None:
        self._waiting: list[threading.Event] = []
        self._lock = threading.Lock()

    def subscribe(self) -> threading.Event:
        e = threading.Event()
        with self._lock:
            self._waiting.append(e)
        return e

    def unsubscribe(self, e: threading.Event) -> None:
        with self._lock:
            if e in self._waiting:
                self._waiting.remove(e)

    def notify(self) -> None:
        with self._lock:
            for e in self._waiting:
                e.set()


class GraphService:
    """Holds the current snapshot; ``refresh`` swaps it when the store has a newer version."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.events = spark, folder, Broadcaster()
        self.snapshot = Snapshot(spark, folder)

    def refresh(self) -> bool:
        if StoreReader(self.spark, self.folder).build_no() == self.snapshot.version:
            return False
        self.snapshot = Snapshot(self.spark, self.folder)  # raises before anything is swapped
        self.events.notify()
        return True

    def watch(self, seconds: float = POLL_SECONDS, on_error: Callable[[Exception], None] | None = None) -> StreamingQuery:
        """Refresh on a Structured Streaming trigger."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()

        def tick(_: DataFrame, __: int) -> None:
            try:
                self.refresh()
            except Exception as e:  # tried again on the next tick
                if on_error:
                    on_error(e)

        return ticks.writeStream.foreachBatch(tick).trigger(processingTime=f"{seconds} seconds").start()


def stream_degrees(edges: DataFrame) -> DataFrame:
    """Running degree of every node of a stream of edges; copies of an edge id count once."""
    once = edges.dropDuplicates([R, "id"])
    return once.select(R, F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy(R, "id").agg(F.count(F.lit(1)).alias("degree"))


def stream_edge_counts(edges: DataFrame, window: str = "30 days", late: str = "10 days") -> DataFrame:
    """Edges per type and window of building; rows later than the watermark are left out."""
    w = edges.withWatermark("built_at", late).groupBy(F.window("built_at", window), "type").agg(F.count(F.lit(1)).alias("n_edges"))
    return w.select(F.col("window.start").alias("window_start"), "type", "n_edges")


def run_once(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Drive a streaming frame through all that is there now; its result, written to the shared folder, as a table."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/codeweft-stream/{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def append_stream(edges: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of edges to a parquet table, each micro-batch exactly once and without copies inside it."""
    def write(batch: DataFrame, no: int) -> None:
        batch.dropDuplicates([R, "id"]).write.mode("overwrite").parquet(f"{folder}/batch={no}")

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
