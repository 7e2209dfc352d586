"""Sharding by sampled splitters, in DataFrame functions only.

Law ``bytes``: the shards' sizes are equal up to one record. Records are put in
the order of a key (hash of the text, then a salt), so equal texts stay near each
other. A size-weighted sample of keys gives quantile boundaries; records are
partitioned by range; ranges that hold too many bytes or rows, as those around a
text with very many copies do, are subdivided by the salt. Exact totals of the
sub-ranges, their prefix sums and a running sum inside each sub-range give every
record its place on the line of all bytes; equal lengths of that line are shards.

Null text: no bytes, the crc of no bytes. Empty tables give no rows. Repeated rows
are separate records. A text is never cut: one that is longer than a shard is the whole
of one, and shards whose line it covers stay empty. Records that tie in key and salt are
put in the order of their ids; whichever comes first, sizes are the same. Only the id
and text columns are read, so the names of other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prefix_offsets, small_side

#: Bytes that each record costs beside its text.
OVERHEAD = 16


def place(key: str, bounds: list[int], low: int, high: int) -> str:
    """SQL for how many of the sorted ``bounds`` are not above ``key``, known to be ``low`` to ``high``: a tree of comparisons."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    return f"CASE WHEN {key} < {bounds[middle]}L THEN {place(key, bounds, low, middle)} ELSE {place(key, bounds, middle + 1, high)} END"


def shard(
    docs: DataFrame,
    shards: int = 40,
    ranges_per_shard: int = 4,
    samples_per_range: int = 64,
    rows_per_range: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each record.

    The sample is about ``shards * ranges_per_shard * samples_per_range`` keys
    whatever the input's size; only its quantiles reach the driver. Steps are
    written to the shared folder as narrow tables without texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        (F.length(raw) + OVERHEAD).cast("long").alias("_size"),
        F.crc32(raw).alias("_crc"),
        F.xxhash64(raw).alias("_key"),
        # the number of the row keeps apart even records that are equal in all columns
        F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("_salt"),
    )
    keyed = scratch.write(keyed, "keyed")
    total, rows, largest = keyed.agg(F.sum("_size"), F.count("*"), F.max("_size")).first()
    ranges = shards * ranges_per_shard
    # a record is drawn with a chance in proportion to its size
    chance = F.col("_size") * (ranges * samples_per_range / max(total or 1, 1))
    drawn = keyed.where((F.xxhash64(F.lit(1), "_salt").cast("double") / 2.0**64 + 0.5) < chance)
    quantiles = [k / ranges for k in range(1, ranges)]
    cuts = drawn.agg(F.percentile_approx("_key", quantiles, 10_000)).first()[0] or []
    # a key that fills whole ranges is the boundary on both sides of its own range
    bounds = sorted({c + d for c in cuts for d in (0, 1) if c + d < 2**63})
    ranged = keyed.withColumn("_range", F.expr(place("_key", bounds, 0, len(bounds))))

    # overfull ranges are subdivided by the salt, which is uniform
    full = F.greatest(F.sum("_size") * ranges / F.lit(float(max(total or 1, 1))), F.count("*") / F.lit(float(rows_per_range)))
    parts = ranged.groupBy("_range").agg(F.ceil(full).cast("long").alias("_parts"))
    sub = F.least(F.floor((F.col("_salt").cast("double") / 2.0**64 + 0.5) * F.col("_parts")), F.col("_parts") - 1)
    # at most two ranges for each sampled boundary, so always few enough to broadcast
    ranged = ranged.join(F.broadcast(parts), "_range").withColumn("_sub", sub.cast("long"))
    ranged = ranged.withColumn("_slice", F.col("_range") * F.lit(1 << 32) + F.col("_sub")).drop("_range", "_parts", "_sub")
    totals = scratch.write(ranged.groupBy("_slice").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows")), "totals")
    order = totals.select(F.col("_slice"), F.col("_bytes"), F.col("_rows"))
    before = prefix_offsets(order, "_slice", "_bytes", "_bytes_before", width=1 << 38)
    before = before.join(prefix_offsets(order, "_slice", "_rows", "_rows_before", width=1 << 38).select("_slice", "_rows_before"), "_slice")
    before = before.select("_slice", "_bytes_before", "_rows_before")

    inside = Window.partitionBy("_slice").orderBy("_key", "_salt", "_id")
    running = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.join(small_side(before, totals.count()), "_slice").select(
        "_id",
        "_size",
        "_crc",
        # the middle of the record decides, in whole numbers
        (F.col("_bytes_before") + running - F.col("_size") + F.floor(F.col("_size") / 2)).alias("_middle"),
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_row"),
    )
    number = F.least(F.lit(shards - 1), F.floor(F.col("_middle").cast("decimal(38,0)") * shards / F.lit(total or 1)).cast("int"))
    placed = scratch.write(placed.withColumn("shard", number), "placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
