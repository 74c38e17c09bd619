"""Per-key sums for keys of which a few hold most rows, with dense accumulator arrays.

Every input split is the same size whatever its keys are. A split dictionary-encodes its keys and adds up its rows
with ``numpy.bincount`` over the codes; what leaves the split is one array block per part of the key space, in which a
key occurs once however often it occurred in the split. The blocks of one part meet in one task, which maps their
dictionaries to one and scatter-adds the counts into its dense array. No task ever sees the rows of a key, so a key
holding nearly all rows costs no more than any other: at most one entry per split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.runtime import shuffle_partitions

#: Rows a split adds up before it sends its arrays on; bounds a worker's memory.
CHUNK = 400_000
#: Entries a reducing task holds unmerged.
HOLD = 1_000_000

BLOCKS = "block int, keys array<string>, sums array<bigint>"


def _encode(keys: pa.ChunkedArray | pa.Array, weights: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """Distinct keys and their sums."""
    coded = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    coded = coded.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    n = len(coded.dictionary)
    if weights is None:
        return coded.dictionary, np.bincount(codes, minlength=n).astype(np.int64)
    sums = np.zeros(n, np.int64)
    np.add.at(sums, codes, weights)
    return coded.dictionary, sums


def _split(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        weights: list[np.ndarray] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            keys, sums = _encode(pa.chunked_array(held), np.concatenate(weights) if weights else None)
            part = (pd.util.hash_array(keys.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            used = np.flatnonzero(np.diff(bounds))
            offsets = pa.array(np.append(bounds[used], bounds[-1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(offsets, keys.take(pa.array(order))), pa.ListArray.from_arrays(offsets, pa.array(sums[order]))],
                ["block", "keys", "sums"],
            )

        for b in batches:
            held.append(b.column(0))
            if b.num_columns > 1:
                weights.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            rows += b.num_rows
            if rows >= CHUNK:
                yield from flush()
                held, weights, rows = [], [], 0
        yield from flush()

    return run


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scatter-add of array blocks; memory follows the distinct keys of the task's parts."""
    keys: list[pa.Array] = []
    sums: list[np.ndarray] = []
    held = base = 0
    for b in batches:
        k = b.column(1).flatten()
        keys.append(k)
        sums.append(b.column(2).flatten().to_numpy(zero_copy_only=False))
        held += len(k)
        if held > base + HOLD:
            k, s = _encode(pa.chunked_array(keys), np.concatenate(sums))
            keys, sums, held, base = [k], [s], len(k), len(k)
    if not held:
        return
    k, s = _encode(pa.chunked_array(keys), np.concatenate(sums))
    for at in range(0, len(k), 65_536):
        yield pa.RecordBatch.from_arrays([k.slice(at, 65_536), pa.array(s[at : at + 65_536])], ["key", "total"])


def dense_sums(df: DataFrame, key: Column, weight: Column | None = None) -> DataFrame:
    """(key string, total bigint): per key the number of rows, or the sum of an integer ``weight``.

    Rows with a null key are left out; a null weight counts as 0; no rows give no keys. Exact, no cap, no sample.
    """
    cols = [key.cast("string").alias("k")] + ([F.coalesce(weight.cast("long"), F.lit(0)).alias("w")] if weight is not None else [])
    parts = shuffle_partitions(df.sparkSession)
    # more parts of the key space than tasks, so that tasks get about as many each
    blocks = df.select(*cols).where(F.col("k").isNotNull()).mapInArrow(_split(4 * parts), BLOCKS)
    return blocks.repartition(parts, "block").mapInArrow(_reduce, "key string, total bigint")
