"""Helpers shared by the training-data operators: what workers keep, Arrow access, prefix sums, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.assign import BROADCAST_ROWS
from ..sources.scratch import Scratch
from .runs import least_labels

T = TypeVar("T")
_HELD: dict = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """What one operator keeps in a Python worker between tasks: tables and caches.

    Workers are used again by later stages. Only the last operator's tables stay,
    so a worker's memory is that of one operator, however long a pipeline is.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, and of not much more than ``size`` bytes unless one row is larger."""
    for batch in batches:
        rows_here = max(1, min(rows, size * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows_here):
            yield batch.slice(at, rows_here)


def id_crc(column: str = "doc_id") -> F.Column:
    """crc32 of an id written as text, as folds use it; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def prefix_offsets(totals: DataFrame, key: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Adds, for each distinct integer ``key``, the sum of ``value`` over smaller keys.

    Two levels: sums inside blocks of ``width`` keys run in parallel; only the
    blocks' totals meet in one task.
    """
    blocks = totals.withColumn("_b", F.floor(F.col(key) / width))
    above = blocks.groupBy("_b").agg(F.sum(value).alias("_t"))
    run = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("_b", F.coalesce(F.sum("_t").over(run), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    got = blocks.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(above, "_b")
    return got.withColumn(out, F.col("_in") + F.col("_above")).drop("_b", "_in", "_above")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side that has been counted; larger sides join by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Edges that one task contracts; fewer edges than this are one partition.
PART_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as node -> smallest node that they reach."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    ends = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks()
    values, at = np.unique(ends.to_numpy(zero_copy_only=False), return_inverse=True)
    n = table.num_rows
    root = least_labels(len(values), at[:n], at[n:])
    some = np.flatnonzero(root != np.arange(len(values)))
    for k in range(0, len(some), 50_000):
        part = some[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(values[part], ends.type), pa.array(values[root[part]], ends.type)], names=["a", "b"])


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", rounds: int = 60, part_edges: int = PART_EDGES) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows (node, root), root the smallest id.

    Each round contracts the edges of every partition to stars, a bounded number of
    edges a task; once they all fit one task, that is the result. While they don't,
    large-star and small-star steps join the partitions' stars. These keep at most
    one row per edge and combine the minimum of a node's neighbours before the
    shuffle. Nodes without an edge are not returned.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_edges")
    kind = edges.schema["a"].dataType.simpleString()
    for k in range(rounds):
        parts = -(-now.count() // part_edges)
        local = scratch.write(now.coalesce(max(1, parts)).mapInArrow(_forest, f"a {kind}, b {kind}"), f"{name}_{k}_local")
        if parts <= 1:
            return local.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large star: every larger neighbour of a node goes to its smallest neighbour (or itself)
        both = local.union(local.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour of a node, and the node, go to the smallest of them
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        now = scratch.write(small.distinct(), f"{name}_{k}_star")
        # done when all rows are node -> root: no root is a node, and no node has two
        above = now.join(now.select(F.col("a").alias("r")).distinct(), F.col("b") == F.col("r"), "left_semi")
        twice = now.groupBy("a").count().where("count > 1")
        if not above.head(1) and not twice.head(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("the components did not settle")
