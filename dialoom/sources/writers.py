"""Sinks: JSON lines, one JSON array, and tables that grow as units finish."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import renumber
from .readers import path_exists
from .scratch import Scratch, remove
from .spread import Spread


def write_jsonl(df: DataFrame, path: str, order: str | None = None, watch: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Overwrites ``path`` with JSON lines. Null fields are written; with ``order``, the files' names follow the order.
    ``watch`` marks the rows for counts as they are written, above the sort, whose sample of the rows would count too."""
    if order:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    df = watch(df) if watch else df
    df.drop(*[c for c in (order,) if c == "pos"]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str, order: str, limit: int = 100_000) -> int:
    """One indented JSON array for people to read. Refuses more than ``limit`` records; returns their number."""
    n = df.count()
    if n > limit:
        raise ValueError(f"{n} records are too many for one JSON array; write JSON lines")
    rows = df.orderBy(order).select(F.to_json(F.struct(*[c for c in df.columns if c != order]), {"ignoreNullFields": "false"}))
    text = json.dumps([json.loads(r[0]) for r in rows.toLocalIterator()], ensure_ascii=False, indent=2)
    write_text(df.sparkSession, path, text)
    return n


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One text file, in any store that Spark knows; folders above it are made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


#: Waves that a table grows by at most: larger tables have larger waves.
MOST_WAVES = 200
#: Positions that the first range of candidates spans at least.
FIRST_SPAN = 1024


def append_missing(
    spark: SparkSession,
    todo: DataFrame,
    path: str,
    key: str,
    run: Callable[[DataFrame], DataFrame],
    wave: int = 10_000,
    pos: str = "pos",
    restart: bool = False,
    report: Callable[[dict], None] | None = None,
    spread: Spread | None = None,
) -> DataFrame:
    """Runs ``run`` on the rows of ``todo`` whose key is not in the table at ``path``, in waves, and appends each wave.

    After a crash, the same call goes on where it stopped, so no costly call is made
    twice for a row that was written. ``restart`` empties the table first. What is
    left to do is found once, numbered in the order of ``pos`` and written; each wave
    reads its range of numbers only, dealt over the tasks by ``spread``. Without one, rows stay in the tasks that read
    them, and what fits one wave is neither numbered nor written first. Waves have
    ``wave`` rows, more where that would be over ``MOST_WAVES`` of them. ``report`` gets the
    counts of each wave as it ends: wave, waves, rows and written.
    """
    if restart and path_exists(spark, path):
        remove(spark, path)
    if path_exists(spark, path):
        todo = todo.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti").select(*todo.columns)
    scratch = Scratch(spark, "waves")
    total = None if spread else todo.count()
    if spread or total > wave:
        left = scratch.write(renumber(todo, pos, "_n"), "todo")
        total = left.count()  # from the files' footers
    else:
        left = None
    wave = max(wave, math.ceil(total / MOST_WAVES))
    waves = math.ceil(total / wave)
    for k in range(waves):
        seen = Observation()
        rows = todo if left is None else left.where((F.col("_n") >= k * wave) & (F.col("_n") < (k + 1) * wave))
        rows = spread.deal(rows, "_n") if spread else rows.drop("_n")
        run(rows).observe(seen, F.count("*").alias("written")).write.mode("append").parquet(path)
        if report:
            report({"wave": k + 1, "waves": waves, "rows": min(wave, total - k * wave), **seen.get})
    if not path_exists(spark, path):
        run(todo.limit(0)).write.mode("append").parquet(path)
    scratch.drop("todo")
    return spark.read.parquet(path)


def cursor_path(path: str) -> str:
    """Where ``first_successes`` keeps how far it has come."""
    return f"{path.rstrip('/')}_cursor"


def first_successes(
    spark: SparkSession,
    rows: DataFrame,
    keep: Column,
    path: str,
    limit: int,
    run: Callable[[DataFrame], DataFrame],
    pos: str = "pos",
    start: int = 0,
    ahead: bool = False,
    resume: bool = False,
    spread: Spread | None = None,
    report: Callable[[dict], None] | None = None,
) -> DataFrame:
    """The first ``limit`` rows, by position from ``start`` on, that ``keep`` holds for and whose call succeeds.

    Candidates are found range by range of positions: each range is filtered, numbered
    and written once, and twice as wide as the one before, so the source is read few
    times and ``keep`` is evaluated once a row, up to the last range that is needed. Each
    wave takes as many candidates as successes are missing, so exactly those calls are
    made that a loop over single rows would make. ``ahead``: after the first wave it asks
    for more, by the share of successes so far; the surplus is cut by position.
    ``spread`` deals a wave over the tasks. ``run`` returns rows of successes only, with ``pos``. A wave's results are a folder
    of their own, and the cursor moves when it is complete: with ``resume`` the same call
    goes on behind the cursor and overwrites a wave that was not finished.
    """
    marks = cursor_path(path)
    asked = got = k = 0
    if resume and path_exists(spark, marks):
        done = spark.read.schema("wave int, after long, asked long, got long").json(marks)
        k, after, asked, got = done.agg(F.max("wave") + 1, F.max("after"), F.sum("asked"), F.sum("got")).first()  # a row a wave
        start = max(start, after + 1)
    else:
        for old in (path, marks):
            if path_exists(spark, old):
                remove(spark, old)
    scratch = Scratch(spark, "candidates")
    last = rows.agg(F.max(pos)).first()[0]
    low, span, ranges = start, max(FIRST_SPAN, 2 * limit), 0
    pool, size, taken = None, 0, 0
    while got < limit:
        if taken == size:
            if last is None or low > last:
                break
            # numbering reads its rows twice: they are written first, so that the filter runs once
            within = scratch.write(rows.where((F.col(pos) >= low) & (F.col(pos) < low + span) & keep), f"kept_{ranges}")
            pool = scratch.write(renumber(within, pos, "_n"), f"range_{ranges}")
            low, span, ranges = low + span, 2 * span, ranges + 1
            size, taken = pool.count(), 0
            if not size and low <= last:  # positions may be sparse: on to the next one that there is
                low = rows.where(F.col(pos) >= low).agg(F.min(pos)).first()[0]
            continue
        missing = limit - got
        want = math.ceil(missing * asked / got) if ahead and got else missing
        here = pool.where((F.col("_n") >= taken) & (F.col("_n") < taken + want))
        after, n = here.agg(F.max(pos), F.count("*")).first()
        seen, made = Observation(), run(spread.deal(here, "_n") if spread else here.drop("_n"))
        if want > missing:
            made = made.orderBy(pos).limit(missing)
        made.observe(seen, F.count("*").alias("written")).write.mode("overwrite").parquet(f"{path}/wave={k:05d}")
        here_got = seen.get["written"]
        write_text(spark, f"{marks}/{k:05d}.json", json.dumps({"wave": k, "after": after, "asked": n, "got": here_got}))
        if report:
            report({"wave": k + 1, "rows": n, "written": here_got, "ranges": ranges})
        taken, asked, got, k = taken + n, asked + n, got + here_got, k + 1
    if not k:
        run(rows.where(keep).limit(0)).write.mode("overwrite").parquet(f"{path}/wave={k:05d}")
    return spark.read.parquet(path).drop("wave")
