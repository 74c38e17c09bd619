"""Changes between full deliveries of a table, from bitmaps over persistent key ordinals.

Keys of a checkout get ordinals that stay theirs. A delivery is then a compressed bitmap of ordinals and a vector of
content fingerprints in ordinal order: ``new AND NOT old`` are the additions, ``old AND NOT new`` the removals, and
where both bits are set unequal vector entries are the changes.

A checkout holding more than its share of all rows is cut into segments by key hash; the list of such checkouts has at
most ``2 * partitions`` entries, whatever the data, which is why it may be broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import shuffle_partitions


class Bitmap:
    """Set of ordinals in containers of 65,536: a sorted list where sparse, packed bits (deflated at rest) where dense."""

    SPARSE = 4096

    def __init__(self, containers: dict[int, np.ndarray]) -> None:
        self._c = containers  # high half -> sorted uint16, or 1,024 uint64 words

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        ordinals = np.unique(np.asarray(ordinals, np.int64))
        c: dict[int, np.ndarray] = {}
        high = ordinals >> 16
        for h, at, n in zip(*np.unique(high, return_index=True, return_counts=True)):
            low = (ordinals[at : at + n] & 0xFFFF).astype(np.uint16)
            c[int(h)] = low if n <= cls.SPARSE else cls._pack(low)
        return cls(c)

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        bits = np.zeros(65_536, np.uint8)
        bits[low] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    @staticmethod
    def _low(c: np.ndarray) -> np.ndarray:
        return c if c.dtype == np.uint16 else np.flatnonzero(np.unpackbits(c.view(np.uint8), bitorder="little")).astype(np.uint16)

    def _with(self, other: Bitmap, keep: bool) -> Bitmap:
        out: dict[int, np.ndarray] = {}
        for h, a in self._c.items():
            b = other._c.get(h)
            if b is None:
                r = a[:0] if keep else a
            elif a.dtype == np.uint64 and b.dtype == np.uint64:
                r = a & b if keep else a & ~b
                low = self._low(r)
                r = low if len(low) <= self.SPARSE else r
            else:
                low = self._low(a)
                hit = np.isin(low, self._low(b), assume_unique=True)
                low = low[hit if keep else ~hit]
                r = low if len(low) <= self.SPARSE else self._pack(low)
            if len(r):
                out[h] = r
        return Bitmap(out)

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._with(other, False)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._with(other, True)

    def ordinals(self) -> np.ndarray:
        parts = [(np.int64(h) << 16) + self._low(c).astype(np.int64) for h, c in sorted(self._c.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def __len__(self) -> int:
        return sum(len(self._low(c)) for c in self._c.values())

    def dump(self) -> bytes:
        head = np.array([[h, int(c.dtype == np.uint64), len(c)] for h, c in sorted(self._c.items())], np.int64).reshape(-1, 3)
        body = b"".join(c.tobytes() for _, c in sorted(self._c.items()))
        return len(head).to_bytes(4, "little") + zlib.compress(head.tobytes() + body, 1)

    @classmethod
    def load(cls, raw: bytes) -> Bitmap:
        n = int.from_bytes(raw[:4], "little")
        data = zlib.decompress(raw[4:])
        head, at, c = np.frombuffer(data[: n * 24], np.int64).reshape(-1, 3), n * 24, {}
        for h, dense, size in head:
            kind = np.uint64 if dense else np.uint16
            c[int(h)] = np.frombuffer(data, kind, int(size), at)
            at += int(size) * (8 if dense else 2)
        return cls(c)


def extend_ordinals(known: pd.DataFrame, ids: np.ndarray) -> pd.DataFrame:
    """(id, ordinal): known keys keep their ordinals, new ones follow the greatest in key order."""
    new = np.setdiff1d(ids.astype(object), known["id"].to_numpy(object))
    at = 0 if known.empty else int(known["ordinal"].max()) + 1
    return pd.concat([known, pd.DataFrame({"id": new, "ordinal": np.arange(at, at + len(new), dtype=np.int64)})], ignore_index=True)


def _changes(ordinal: np.ndarray, snapshot: np.ndarray, mark: np.ndarray, size: int, deliveries: list[int], compare: bool) -> Iterator[tuple[int, str, np.ndarray]]:
    """(snapshot_no, change, ordinals) between each delivery and the one before it."""
    before: tuple[Bitmap, np.ndarray] | None = None
    for no in deliveries:
        own = snapshot == no
        bits, vector = Bitmap.of(ordinal[own]), np.zeros(size, np.uint64)
        np.maximum.at(vector, ordinal[own], mark[own])
        if before is not None:
            yield no, "added", bits.and_not(before[0]).ordinals()
            yield no, "removed", before[0].and_not(bits).ordinals()
            if compare:
                both = (bits & before[0]).ordinals()
                yield no, "changed", both[vector[both] != before[1][both]]
        before = bits, vector


OUT = "tab string, repo_path string, id string, snapshot_no int, change string"


def _segment(key: tuple, rows: pd.DataFrame, delivered: pd.DataFrame) -> pd.DataFrame:
    found = []
    deliveries = sorted(delivered["d_no"].unique())
    for tab, own in rows.groupby("tab"):
        ids = own["id"].to_numpy(object)
        names = extend_ordinals(pd.DataFrame({"id": np.empty(0, object), "ordinal": np.empty(0, np.int64)}), ids)["id"].to_numpy(object)
        ordinal = np.searchsorted(names, ids)
        for no, change, hit in _changes(ordinal, own["snapshot_no"].to_numpy(), own["mark"].to_numpy(np.int64).view(np.uint64), len(names), deliveries, tab == "nodes"):
            if len(hit):
                found.append(pd.DataFrame({"tab": tab, "repo_path": key[0], "id": names[hit], "snapshot_no": np.int32(no), "change": change}))
    if not found:
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("tab", object), ("repo_path", object), ("id", object), ("snapshot_no", np.int32), ("change", object))})
    return pd.concat(found, ignore_index=True)


def snapshot_changes(node_snapshots: DataFrame, edge_snapshots: DataFrame) -> DataFrame:
    """(tab, repo_path, id, snapshot_no, change): added, removed or changed against the checkout's previous delivery.

    Deliveries are those in which ``node_snapshots`` holds the checkout. Rows with a null repo_path, id or number are
    left out; copies count once; a null hash is a content of its own; letter case of hashes is ignored. Where one
    delivery holds several hashes for an id, the greatest fingerprint counts. No rows: no changes.
    """
    spark = node_snapshots.sparkSession
    content = F.xxhash64(F.coalesce(F.lower("hash"), F.lit("\0")))
    both = node_snapshots.select(F.lit("nodes").alias("tab"), "repo_path", "id", "snapshot_no", content.alias("mark")).unionByName(
        edge_snapshots.select(F.lit("edges").alias("tab"), "repo_path", "id", "snapshot_no", F.lit(1).cast("long").alias("mark"))
    )
    both = both.where(F.col("repo_path").isNotNull() & F.col("id").isNotNull() & F.col("snapshot_no").isNotNull())

    # Checkouts with more rows than half a partition's share get segments in proportion. At most 2 * partitions of them.
    parts = shuffle_partitions(spark)
    sizes = both.groupBy("repo_path").agg(F.count(F.lit(1)).alias("n"))
    share = sizes.agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / (2 * parts)).cast("long")).alias("share"))
    large = F.broadcast(
        sizes.where(F.col("n") > share.scalar()).select(F.col("repo_path").alias("_r"), F.ceil(F.col("n") / share.scalar()).cast("int").alias("segments"))
    )
    segmented = (
        both.join(large, F.col("repo_path") == F.col("_r"), "left")
        .withColumn("segment", F.when(F.col("segments").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("segments"))).cast("int"))
        .select("tab", "repo_path", "segment", "id", "snapshot_no", "mark")
    )
    delivered = (
        node_snapshots.where(F.col("repo_path").isNotNull() & F.col("snapshot_no").isNotNull())
        .select("repo_path", "snapshot_no").distinct()
        .join(large, F.col("repo_path") == F.col("_r"), "left")
        .select(F.col("repo_path").alias("d_repo"), F.explode(F.sequence(F.lit(0), F.coalesce(F.col("segments"), F.lit(1)) - 1)).alias("d_segment"), F.col("snapshot_no").alias("d_no"))
    )
    return segmented.groupBy("repo_path", "segment").cogroup(delivered.groupBy("d_repo", "d_segment")).applyInPandas(_segment, OUT)
