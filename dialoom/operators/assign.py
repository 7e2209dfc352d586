"""Selection, pairing, round-robin assignment, shuffles and splits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import SPLIT_SEED, TRAIN_SHARE
from .positions import hash_order, renumber

#: Rows of a side that may be broadcast after it has been counted.
BROADCAST_ROWS = 200_000
#: Rows that the driver permutes at most.
PERMUTED_ROWS = 10_000_000


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast while the counted side is small; beyond, Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def first_passing(df: DataFrame, keep: Column, limit: int, pos: str = "pos", start: int = 0) -> DataFrame:
    """The first ``limit`` rows from source position ``start`` on for which ``keep`` holds: a top-k by position."""
    return df.where((F.col(pos) >= start) & keep).orderBy(pos).limit(limit)


def slice_rows(df: DataFrame, limit: int, pos: str = "pos") -> DataFrame:
    """The rows at the first ``limit`` positions, before any other filter."""
    return df.where(F.col(pos) < limit)


def last_wins(df: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """One row a key: the last one's values at the first one's place (``place``). Combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    kept = df.groupBy(key.alias("key")).agg(F.max_by(row, F.col(pos)).alias("_row"), F.min(pos).alias("place"))
    return kept.select("key", "place", "_row.*")


def record_key(id_col: str = "id", source_col: str = "source_id", columns: list[str] | None = None) -> Column:
    """The id, or where that is null or empty the source's id."""
    a = F.nullif(F.col(id_col), F.lit("")) if columns is None or id_col in columns else F.lit(None).cast("string")
    b = F.col(source_col) if columns is None or source_col in columns else F.lit(None).cast("string")
    return F.coalesce(a, b)


def pair(left: DataFrame, right: DataFrame, key: str = "key", place: str = "place") -> DataFrame:
    """Rows of ``left`` that have a partner, with the partner's columns as ``other_...``; ``place`` keeps the order."""
    other = right.select(F.col(key), *[F.col(c).alias(f"other_{c}") for c in right.columns if c != key])
    return left.join(other, key)  # a side is broadcast where its size, as measured at run time, is below Spark's limit


def round_robin(df: DataFrame, presets: DataFrame, pos: str = "pos", ord_col: str = "ord", prefix: str = "preset_") -> DataFrame:
    """Deals presets out by source position; skipped rows use up a place. ``presets`` are few rows with ``ord`` from 0."""
    n = presets.count()
    named = presets.select(F.col(ord_col).cast("long").alias("_turn"), *[F.col(c).alias(f"{prefix}{c}") for c in presets.columns if c != ord_col])
    return df.withColumn("_turn", F.col(pos) % F.lit(max(n, 1))).join(small_side(named), "_turn").drop("_turn")


def round_robin_matched(df: DataFrame, presets: DataFrame, place: str = "place", ord_col: str = "ord", prefix: str = "preset_") -> DataFrame:
    """Deals presets out over the rows that are there: the counter moves for each of them only."""
    return round_robin(renumber(df, place, "turn_pos"), presets, "turn_pos", ord_col, prefix)


def seeded_shuffle(spark: SparkSession, df: DataFrame, n: int, pos: str = "pos", seed: int = SPLIT_SEED) -> DataFrame:
    """The permutation that Python's generator gives for ``n`` rows numbered 0 to n-1 by ``pos``; adds ``shuffled``.

    Exact, and the driver makes n numbers: more than ``PERMUTED_ROWS`` are refused.
    Beyond, use ``hash_split``.
    """
    if n > PERMUTED_ROWS:
        raise ValueError(f"{n} rows are too many for a permutation made on the driver; use hash_split")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    places = spark.createDataFrame([(p, k) for k, p in enumerate(order)], "_pos long, shuffled long")
    return df.join(small_side(places), F.col(pos) == F.col("_pos")).drop("_pos")


def split_column(position: Column, n: Column | int, share: float = TRAIN_SHARE) -> Column:
    """``train`` for the first int(n * share) positions, else ``val``."""
    size = F.floor((n if isinstance(n, Column) else F.lit(n)) * F.lit(share))
    return F.when(position < size, "train").otherwise("val")


def seeded_split(spark: SparkSession, df: DataFrame, pos: str = "pos", seed: int = SPLIT_SEED, share: float = TRAIN_SHARE) -> DataFrame:
    n = df.count()
    return seeded_shuffle(spark, df, n, pos, seed).withColumn("split", split_column(F.col("shuffled"), n, share))


def split_sizes(df: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """(split, n): how many rows each part of a split gets, whatever the order; one row a part, none for no rows."""
    counted = df.agg(F.count("*").alias("n")).where("n > 0")
    train = F.floor(F.col("n") * F.lit(share))
    parts = F.array(F.struct(F.lit("train").alias("split"), train.alias("n")), F.struct(F.lit("val").alias("split"), (F.col("n") - train).alias("n")))
    return counted.select(F.explode(parts).alias("p")).select("p.*").where("n > 0")


def hash_split(df: DataFrame, key: str, seed: int = SPLIT_SEED, share: float = TRAIN_SHARE) -> DataFrame:
    """A reproducible split of any size: rows in the order of a salted digest of their key."""
    n = df.count()
    return hash_order(df, seed, key, "shuffled").withColumn("split", split_column(F.col("shuffled"), n, share))


def pool_overlap(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Values of ``columns`` that both pools hold; pools that are apart give no row."""
    return a.select(*columns).intersect(b.select(*columns))
