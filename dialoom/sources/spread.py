"""How costly calls are dealt over the executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spread:
    """At most ``in_flight`` calls are open at once, over all tasks together; ``parts``: tasks, by default one a slot.

    The limit is divided over the tasks, so it holds however many of them run at a time."""

    in_flight: int = 64
    parts: int | None = None

    def plan(self, spark: SparkSession) -> tuple[int, int]:
        """(tasks, calls that each has open)."""
        parts = max(1, min(self.parts or spark.sparkContext.defaultParallelism, self.in_flight))
        return parts, max(1, self.in_flight // parts)

    def deal(self, rows: DataFrame, number: str) -> DataFrame:
        """Rows dealt out in turn by their consecutive ``number``: the tasks' rows differ by one at most. Drops the number."""
        parts, _ = self.plan(rows.sparkSession)
        return rows.repartitionById(parts, (F.col(number) % parts).cast("int")).drop(number)
