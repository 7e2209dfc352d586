"""Numeric band join: each item with the lines whose unit price is near its own price.

Both sides are first brought down to prices, since lines at one price only differ in
what they add: a unit price carries how many lines it has, the sum of their checksums
and their first lines in order (at most ``2 * first``, of one item at most ``first``, so
that for any item that is left out the first ``first`` others are among them). Map tasks
combine before the shuffle, so a price that holds a third of all lines is a few rows a
task. Items come down to their distinct prices.

Both sides' prices are sorted into blocks by ranges, each with its smallest and largest
value. Zones of the blocks (an item block's is widened by its reach) meet in an equality
join on cells of a grid whose width grows with the price as the reach does; blocks whose
zones overlap are the pairs of a join, any other pair is never read. Each pair is a tile:
numpy compares all its prices at once and sums what hits; first lines are merged from
tile to tile, bounded. What an item's own lines have added is taken off by a join on the
item, and its own lines are left out of the price's first lines.

Nothing goes through one task, the driver or a broadcast that grows with the input: at
most 1,000 items and 1,000 prices that each hold over a thousandth of all rows come to
the driver, and these are salted on both sides of a join.

Defined cases: lines null in sale, item, quantity or amount, lines of quantity 0 and
prices or amounts that are not finite or are 2**50 cents or more never pair; a null line
number comes first in the order and is empty in the checksum's text. Negative numbers are
rounded down as others are. An item null in its id or price has no pair. Each row of items
is an item: repeated rows give repeated results. Repeated lines each count and take a rank
each. Ties go by gap, unit price, sale, line number and item. Without lines every item has
one row of rank 0; without items there is no row. Other columns are not read. Sums beyond
64 bits fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Keys that hold more than one of so many rows are salted, so there are at most so many.
HOT = 1000
SALTS = 32
#: Prices of an item block, unit prices of a line block, rows that a task combines at a time.
ITEM_BLOCK, LINE_BLOCK, CHUNK = 128, 128, 500_000
#: Beyond, doubles do not hold single cents well and products leave 64 bits.
LIMIT = float(1 << 50)
NO_LINE = -(1 << 63)

UNIT = "u long, item long, sale long, line long, n long, crc long"
OWN = "item long, u long, n long, crc long"
LISTS = ("sale", "line", "item")


# --- prices -----------------------------------------------------------------


def cents(amount: Column) -> Column:
    """Whole cents of an amount, half up; null where there is no finite amount in bounds."""
    scaled = amount.cast("double") * 100 + 0.5
    return F.when(~F.isnan(scaled) & (F.abs(scaled) < LIMIT), F.floor(scaled))


def unit_price(a: Column, quantity: Column) -> Column:
    """floor((2a + q) / 2q) in whole numbers, for either sign of q; null for no quantity."""
    q = quantity.cast("long")
    over, below = (F.lit(2) * a + q) * F.signum(q).cast("long"), F.abs(q) * 2
    return F.when(q != 0, F.call_function("div", over - F.pmod(over, below), below))


def near(gap: Column, u: Column, p: Column, cents_apart: int, per_mille: int) -> Column:
    return (gap <= cents_apart) | (gap * 1000 <= F.least(u, p) * per_mille)


def reach(p: np.ndarray, cents_apart: int, per_mille: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest unit price that can be near each price."""
    up = np.maximum(p, 0)
    low = np.minimum(p - cents_apart, np.where(p > 0, -(-1000 * up // (1000 + per_mille)), p))
    return low, p + np.maximum(cents_apart, per_mille * up // 1000)


def cell(x: Column) -> Column:
    """The number of a grid cell: some cents wide at zero, about a fiftieth of the price far from it. It grows with ``x``;
    there are at most some 1,300 on either side of zero."""
    size = F.floor(F.log1p(F.abs(x).cast("double") / 10_000) / float(np.log1p(0.02))).cast("int")
    return F.when(x >= 0, size).otherwise(-1 - size)


# --- first lines ------------------------------------------------------------


def first_of(group: np.ndarray, item: np.ndarray, order: np.ndarray, first: int) -> np.ndarray:
    """Of rows in ``order`` (groups together), those that are kept: at most ``first`` of an item, ``2 * first`` of a group."""
    for by, most in (((item, group), first), ((group,), 2 * first)):
        if not len(order):
            return order
        place = np.lexsort((np.arange(len(order)), *(k[order] for k in by)))
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in by:
            sorted_k = k[order][place]
            new[1:] |= sorted_k[1:] != sorted_k[:-1]
        begins = np.flatnonzero(new)
        rank = np.empty(len(order), np.int64)
        rank[place] = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        order = order[rank < most]
    return order


def sums_of(begins: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of runs; fails where they leave 64 bits."""
    if len(begins) and np.add.reduceat(np.abs(values).astype(float), begins).max() > 9.2e18:
        raise OverflowError("a sum of the band join leaves 64 bits")
    return np.add.reduceat(values, begins) if len(begins) else values[:0]


def _columns(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    table = pa.Table.from_batches(batches)
    return [c.combine_chunks().to_numpy(zero_copy_only=False) for c in table.columns]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            yield _columns(held)
            held, count = [], 0
    if held:
        yield _columns(held)


def _reduced(columns: list[np.ndarray], first: int) -> list[np.ndarray]:
    """Rows (u, item, sale, line, n, crc) brought down to first lines in order; the first row of a price holds its sums."""
    u, item, sale, line, n, crc = columns
    order = np.lexsort((item, line, sale, u))
    begins = np.flatnonzero(np.append(True, np.diff(u[order]) != 0))
    totals = [sums_of(begins, v[order]) for v in (n, crc)]
    kept = first_of(u, item, order, first)
    heads = np.flatnonzero(np.append(True, np.diff(u[kept]) != 0))
    out = [v[kept] for v in (u, item, sale, line)]
    for total in totals:
        placed = np.zeros(len(kept), np.int64)
        placed[heads] = total
        out.append(placed)
    return out


def _partial_units(first: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _chunks(batches, chunk):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _reduced(columns, first)], names=["u", "item", "sale", "line", "n", "crc"])

    return run


def _units(first: int, chunk: int):
    """Rows sorted by price to one row a price, holding a chunk and one price's first lines at most."""

    def packed(columns: list[np.ndarray]) -> pa.RecordBatch:
        u, item, sale, line, n, crc = columns
        begins = np.flatnonzero(np.append(True, np.diff(u) != 0))
        ends = pa.array(np.append(begins, len(u)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (sale, line, item)]
        return pa.RecordBatch.from_arrays([*(pa.array(v[begins]) for v in (u, n, crc)), *lists], names=["u", "n", "crc", *LISTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for columns in _chunks(batches, chunk):
            if held:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            rows = _reduced(columns, first)
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last price may go on
            if cut:
                yield packed([c[:cut] for c in rows])
            held = [c[cut:] for c in rows]
        if held:
            yield packed(held)

    return run


def _own_groups(chunk: int):
    """Lines (item, u, crc) combined by item and price, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, u, crc in _chunks(batches, chunk):
            order = np.lexsort((u, item))
            item, u = item[order], u[order]
            begins = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(u) != 0)))
            counts = np.diff(np.append(begins, len(u)))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (item[begins], u[begins], counts, sums_of(begins, crc[order]))], names=["item", "u", "n", "crc"])

    return run


# --- blocks and tiles -------------------------------------------------------


def _blocks(size: int, widen: tuple[int, int] | None):
    """Sorted rows, a price each, to rows of ``size`` prices: number, zone, and the columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32

        def block(table: pa.Table) -> pa.RecordBatch:
            nonlocal at
            values = table.column(0).to_numpy()
            low, high = reach(values, *widen) if widen else (values, values)
            columns = [pa.array([at]), pa.array([int(low.min())]), pa.array([int(high.max())])]
            names = ["block", "low", "high"]
            for name, column in zip(table.column_names, table.columns):
                column = column.combine_chunks()
                if pa.types.is_list(column.type):
                    if name == LISTS[0]:
                        columns.append(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.value_lengths().cast(pa.int64())))
                        names.append("lines")
                    column = column.flatten()
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column))
                names.append(name)
            at += 1
            return pa.RecordBatch.from_arrays(columns, names=names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while table.num_rows >= size:
                yield block(table.slice(0, size))
                table = table.slice(size)
            held = table.to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return run


PARTIAL = ["p", "n", "gap_sum", "crc", "gap", "u", *LISTS]


def _listed(p: np.ndarray, sums: list[np.ndarray], counts: np.ndarray, lists: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    columns = [pa.array(v) for v in (p, *sums)] + [pa.ListArray.from_arrays(ends, pa.array(v)) for v in lists]
    return pa.RecordBatch.from_arrays(columns, names=PARTIAL)


def compare_tile(p: np.ndarray, u: np.ndarray, n: np.ndarray, crc: np.ndarray, lines: np.ndarray, lists: list[np.ndarray], first: int, cents_apart: int, per_mille: int) -> pa.RecordBatch:
    """All prices of an item block against all of a line block: sums and first lines of each price that is hit.

    ``u`` is sorted; ``lines`` says how many entries of ``lists`` (sale, line, item) each unit price has."""
    gap = np.abs(u[None, :] - p[:, None])
    hit = (gap <= cents_apart) | (1000 * gap <= per_mille * np.minimum(u[None, :], p[:, None]))
    some = hit.any(1)
    p, gap, hit = p[some], gap[some], hit[some]
    if (hit * (crc + 0.0)).sum(1).max(initial=0) > 9.2e18 or ((hit * gap) * (n + 0.0)).sum(1).max(initial=0) > 9.2e18:
        raise OverflowError("a sum of the band join leaves 64 bits")
    sums = [(hit * n).sum(1), (hit * gap * n).sum(1), (hit * crc).sum(1)]
    # the nearest entries lie around the price: of 4 * first on either side, whole prices make up 2 * first
    begin = np.append(0, np.cumsum(lines))
    of = np.repeat(np.arange(len(u)), lines)
    middle = begin[np.searchsorted(u, p)]
    at = middle[:, None] + np.arange(-4 * first, 4 * first)[None, :]
    inside = (at >= 0) & (at < len(of))
    at = np.where(inside, at, 0)
    row = np.arange(len(p))[:, None]
    inside &= hit[row, of[at]]
    key = np.where(inside, gap[row, of[at]] * len(of) + at, np.iinfo(np.int64).max)
    nearest = np.argsort(key, 1)[:, : 2 * first]
    at, inside = np.take_along_axis(at, nearest, 1), np.take_along_axis(inside, nearest, 1)
    # more than ``first`` of one item among them: all entries that are hit have a say
    owner = np.sort(np.where(inside, lists[2][at], NO_LINE), 1)
    crowded = ((owner[:, first:] == owner[:, :-first]) & (owner[:, first:] != NO_LINE)).any(1)
    rows, cols = np.nonzero(inside & ~crowded[:, None])
    entry = at[rows, cols]
    if crowded.any():
        which = np.flatnonzero(crowded)
        r, e = np.nonzero(hit[which][:, of])
        r = which[r]
        kept = first_of(r, lists[2][e], np.lexsort((e, gap[r, of[e]], r)), first)
        rows, entry = np.append(rows, r[kept]), np.append(entry, e[kept])
        put = np.argsort(rows, kind="stable")
        rows, entry = rows[put], entry[put]
    return _listed(p, sums, np.bincount(rows, minlength=len(p)), [gap[rows, of[entry]], u[of[entry]], *(v[entry] for v in lists)])


def _tiles(first: int, cents_apart: int, per_mille: int):
    names = ["p", "u", "n", "crc", "lines", *LISTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            for k in range(batch.num_rows):
                p, u, n, crc, lines, *lists = (c[k].values.to_numpy() for c in columns)
                yield compare_tile(p, u, n, crc, lines, lists, first, cents_apart, per_mille)

    return run


def _merged(batches: list[pa.RecordBatch], first: int) -> pa.RecordBatch:
    """Rows of the same prices from several tiles to one row a price."""
    table = pa.Table.from_batches(batches).combine_chunks()
    p, n, gaps, crc = (table.column(k).to_numpy() for k in range(4))
    flat = [table.column(k).combine_chunks() for k in range(4, 9)]
    of = np.repeat(p, flat[0].value_lengths().to_numpy(zero_copy_only=False))
    gap, u, sale, line, item = (c.flatten().to_numpy() for c in flat)
    order = np.argsort(p, kind="stable")
    begins = np.flatnonzero(np.append(True, np.diff(p[order]) != 0))
    kept = first_of(of, item, np.lexsort((item, line, sale, u, gap, of)), first)
    prices = p[order][begins]
    counts = np.bincount(np.searchsorted(prices, of[kept]), minlength=len(prices))
    return _listed(prices, [sums_of(begins, v[order]) for v in (n, gaps, crc)], counts, [v[kept] for v in (gap, u, sale, line, item)])


def _merge(first: int, rows: int = 8192):
    """Rows sorted by price; holds ``rows`` of them and one merged row at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held.append(batch.slice(at, rows))
                if sum(b.num_rows for b in held) >= rows:
                    done = _merged(held, first)
                    if done.num_rows > 1:
                        yield done.slice(0, done.num_rows - 1)
                    held = [done.slice(done.num_rows - 1)]
        if sum(b.num_rows for b in held):
            yield _merged(held, first)

    return run


# --- the join ---------------------------------------------------------------


def _hot(counted: DataFrame, key: str) -> list:
    """The keys that hold more than one of ``HOT`` rows; so at most ``HOT`` of them."""
    total = counted.agg(F.sum("rows")).first()[0] or 0
    return [r[0] for r in counted.where(F.col("rows") * HOT > total).select(key).collect()]


def _salted(rows: DataFrame, other: DataFrame, key: str, hot: list, spread: Column, how: str = "inner") -> DataFrame:
    """Joins on ``key``; rows of hot keys are spread over salts, and the other side has a copy for each salt."""
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    other = other.withColumn("_salt", F.explode(salts))
    return rows.withColumn("_salt", salt).join(other.hint("merge"), [key, "_salt"], how).drop("_salt")


def band_join(
    lines: DataFrame,
    items: DataFrame,
    first: int = 10,
    cents_apart: int = 50,
    per_mille: int = 5,
    item_block: int = ITEM_BLOCK,
    line_block: int = LINE_BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """(item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc): each item's first pairs, and
    its counts and sums over all its pairs; one row of rank 0 for an item without any.

    A pair is near if its gap is at most ``cents_apart``, or ``per_mille`` thousandths of the lower price."""
    scratch = Scratch(lines.sparkSession, "band")
    widen = (cents_apart, per_mille)
    text = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string"))
    full = lines.where("sale_id is not null and item_id is not null and quantity is not null and amount is not null").select(
        unit_price(cents(F.col("amount")), F.col("quantity")).alias("u"),
        F.col("item_id").cast("long").alias("item"),
        F.col("sale_id").cast("long").alias("sale"),
        F.coalesce(F.col("line_no").cast("long"), F.lit(NO_LINE)).alias("line"),
        F.crc32(text.cast("binary")).alias("crc"),
    )
    full = full.where("u is not null")
    price = F.when(F.col("item_id").isNotNull(), cents(F.col("price")))
    wares = items.select(F.col("item_id").cast("long").alias("item"), price.alias("p")).groupBy("item", "p").agg(F.count("*").alias("rows"))
    wares = scratch.write(wares, "items")
    priced = wares.where("p is not null")

    # lines by unit price, first lines kept
    units = full.select("u", "item", "sale", "line", F.lit(1).cast("long").alias("n"), "crc").mapInArrow(_partial_units(first, chunk), UNIT)
    units = units.repartition("u").sortWithinPartitions("u").mapInArrow(_units(first, chunk), "u long, n long, crc long, sale array<long>, line array<long>, item array<long>")
    units = scratch.write(units, "units")
    lists = ", ".join(f"{c} array<long>" for c in ("u", "n", "crc", "lines", *LISTS))
    zone = "block long, low long, high long"
    line_blocks = scratch.write(units.repartitionByRange("u").sortWithinPartitions("u").mapInArrow(_blocks(line_block, None), f"{zone}, {lists}"), "line_blocks")
    prices = scratch.write(priced.groupBy("p").agg(F.count("*").alias("rows")), "prices")
    item_blocks = prices.select("p").repartitionByRange("p").sortWithinPartitions("p").mapInArrow(_blocks(item_block, widen), f"{zone}, p array<long>")
    item_blocks = scratch.write(item_blocks, "item_blocks")

    # pairs of blocks whose zones overlap, found in the first cell that both have
    def zones(blocks: DataFrame, name: str) -> DataFrame:
        kept = blocks.select(F.col("block").alias(name), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"), cell(F.col("low")).alias(f"{name}_cell"))
        return kept.withColumn("cell", F.explode(F.sequence(f"{name}_cell", cell(F.col(f"{name}_high")))))

    met = zones(item_blocks, "a").join(zones(line_blocks, "b").hint("merge"), "cell")
    met = met.where("cell = greatest(a_cell, b_cell) and a_low <= b_high and b_low <= a_high").select("a", "b")
    tiles = met.join(item_blocks.select(F.col("block").alias("a"), "p").hint("merge"), "a").select("b", "p")
    tiles = tiles.join(line_blocks.drop("low", "high").withColumnRenamed("block", "b").hint("merge"), "b")
    lists = ", ".join(f"{c} array<long>" for c in PARTIAL[4:])
    kinds = f"p long, n long, gap_sum long, crc long, {lists}"
    found = tiles.mapInArrow(_tiles(first, *widen), kinds).repartition("p").sortWithinPartitions("p").mapInArrow(_merge(first), kinds)
    found = scratch.write(found.withColumnRenamed("item", "owner"), "found")

    # what the items' own lines have added
    hot_items = _hot(full.groupBy("item").agg(F.count("*").alias("rows")), "item")
    own = full.select("item", "u", "crc").mapInArrow(_own_groups(chunk), OWN)
    own = _salted(own, priced.select("item", "p"), "item", hot_items, F.col("u")).withColumn("gap", F.abs(F.col("u") - F.col("p")))
    own = own.where(near(F.col("gap"), F.col("u"), F.col("p"), *widen))
    own = own.groupBy("item", "p").agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * F.col("gap")).alias("own_gap"), F.sum("crc").alias("own_crc"))

    got = _salted(wares, found, "p", _hot(prices, "p"), F.col("item"), "left").join(own.hint("merge"), ["item", "p"], "left")
    others = F.filter(F.arrays_zip("gap", "u", "sale", "line", "owner"), lambda x: x["owner"] != F.col("item"))
    less = lambda a, b: (F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))).cast("long")
    got = got.select(
        F.col("item").alias("item_id"),
        "rows",
        F.slice(others, 1, first).alias("pairs"),
        less("n", "own_n").alias("n_pairs"),
        less("gap_sum", "own_gap").alias("gap_sum"),
        less("crc", "own_crc").alias("lines_crc"),
    )
    got = got.select("*", F.posexplode_outer("pairs").alias("place", "x")).drop("pairs")
    # repeated items, a thousand of them to a piece of work
    if (wares.agg(F.max("rows")).first()[0] or 0) > 1:
        got = got.withColumn("part", F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("rows") - 1, F.lit(1000)))))
        copies = F.least(F.lit(1000), F.col("rows") - F.col("part") * 1000).cast("int")
        got = got.repartition("item_id", "place", "part").withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("part", "copy")
    return got.select(
        "item_id",
        F.coalesce(F.col("place") + 1, F.lit(0)).cast("int").alias("rank"),
        F.col("x.gap").alias("gap"),
        F.col("x.u").alias("u"),
        F.col("x.sale").alias("sale_id"),
        F.nullif(F.col("x.line"), F.lit(NO_LINE)).alias("line_no"),
        F.col("x.owner").alias("line_item_id"),
        "n_pairs",
        "gap_sum",
        "lines_crc",
    )
