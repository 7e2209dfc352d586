"""Positions of rows, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, out: str, *order: Column, block: Column) -> DataFrame:
    """Numbers rows from 0 in the order of (``block``, ``order``).

    ``block`` cuts the order into blocks; only the blocks' row counts meet in one
    task, the rows themselves are numbered block by block.
    """
    blocked = df.withColumn("_block", block)
    counts = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(*order)
    numbered = blocked.withColumn("_in", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(counts, "_block").withColumn(out, F.col("_before") + F.col("_in")).drop("_block", "_in", "_before")


def renumber(df: DataFrame, pos: str, out: str, width: int = 1 << 20) -> DataFrame:
    """Dense positions 0, 1, 2 ... of the rows that are left, in the order of their distinct source position ``pos``."""
    return number_rows(df, out, F.col(pos), block=F.floor(F.col(pos) / width))


def hash_order(df: DataFrame, seed: int, key: str, out: str) -> DataFrame:
    """Positions of a reproducible shuffle: the order of md5("seed:key"), then of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = df.withColumn("_digest", digest)
    return number_rows(hashed, out, F.col("_digest"), F.col(key), block=F.substring("_digest", 1, 4)).drop("_digest")
