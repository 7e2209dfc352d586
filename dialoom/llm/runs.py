"""Buckets of a hash join handled as runs of sorted rows, split into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 4096, size: int = 32 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal first ``keys`` columns, with the places where the runs begin (and the end).

    Rows must come sorted by these columns. At most one run and about ``rows`` rows or
    ``size`` bytes are held.
    """
    held: list[pa.RecordBatch] = []
    count = 0.0  # share of a table that is held

    def starts(table: pa.Table) -> np.ndarray:
        change = np.ones(table.num_rows, bool)
        if table.num_rows:
            change[1:] = False
        for k in range(keys):
            column = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            held.append(part := batch.slice(at, step))
            count += max(part.num_rows / rows, part.nbytes / size)
            if count < 1:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            begin = starts(table)
            if len(begin) > 1:
                yield table.slice(0, int(begin[-1])), begin
                rest = table.slice(int(begin[-1])).combine_chunks()
                held, count = rest.to_batches(), 0
            else:
                held = table.to_batches()
                count = 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table, np.append(starts(table), table.num_rows)


def fixed(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """A binary column whose values have one length, as a matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = array.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1) if values else np.zeros((0, 1), kind)


def block_pairs(rows: DataFrame, count: str, member: str, size: int) -> DataFrame:
    """Splits each bucket of ``count`` rows into blocks of about ``size`` and deals every pair of blocks out.

    Adds ``_lo`` and ``_hi``, the pair of blocks, and ``_own``, the row's block. A row
    is copied once for each block of its bucket, so a bucket of m rows makes m*m/size
    copies, not m*m pairs, and no task holds more than two blocks of it.
    """
    blocks = F.ceil(F.col(count) / size).cast("int")
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64(member), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other")).drop("_other")


def grouped_pairs(begin: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) inside the ``chosen`` runs; runs of equal length together."""
    sizes = np.diff(begin)
    for m in np.unique(sizes[(sizes > 1) & chosen]).tolist():
        a, b = np.triu_indices(m, 1)
        at = begin[:-1][(sizes == m) & chosen]
        step = max(1, 200_000 // len(a))
        for k in range(0, len(at), step):
            some = at[k : k + step, None]
            yield (some + a).ravel(), (some + b).ravel()


def led_pairs(begin: np.ndarray, leads: np.ndarray, among: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs inside the runs that hold a leader: all pairs of runs of leaders only; in others leaders
    with the rest and, if ``among``, with each other."""
    if len(begin) < 2:
        return
    led = np.add.reduceat(leads.astype(np.int64), begin[:-1])
    full = led == np.diff(begin)
    yield from grouped_pairs(begin, full)
    for r in np.flatnonzero(~full & (led > 0)).tolist():
        lo = int(begin[r])
        here = leads[lo : int(begin[r + 1])]
        lead, rest = lo + np.flatnonzero(here), lo + np.flatnonzero(~here)
        step = max(1, 200_000 // len(rest))
        for k in range(0, len(lead), step):
            some = lead[k : k + step]
            yield np.repeat(some, len(rest)), np.tile(rest, len(some))
        if among and len(lead) > 1:
            a, b = np.triu_indices(len(lead), 1)
            yield lead[a], lead[b]


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that edges (a, b) reach, within one block."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after
