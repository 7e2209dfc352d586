"""Counts that come with the job that writes, of batches and of streams alike."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress:
    """Named counts of the steps of a run, gathered while the steps write; no scan of their own.

    ``watch`` marks a batch DataFrame; its counts are there when an action on it has ended. ``watch_stream`` marks a
    stream; its counts add up over its micro-batches. ``report`` gets (step, counts) as they arrive.
    """

    def __init__(self, spark: SparkSession, report: Callable[[str, dict], None] | None = None) -> None:
        self.spark, self.report = spark, report
        self._batches: dict[str, list[Observation]] = {}
        self._streams: dict[str, tuple[str, dict[str, int]]] = {}
        self._seen: set[tuple[str, int, str]] = set()
        self._lock = threading.Lock()
        self._listener: StreamingQueryListener | None = None

    def watch(self, df: DataFrame, step: str, **counts: Column) -> DataFrame:
        seen = Observation()
        self._batches.setdefault(step, []).append(seen)
        return df.observe(seen, *[c.alias(name) for name, c in counts.items()])

    def done(self, step: str) -> dict[str, int]:
        """The step's counts; waits for the actions on what was watched."""
        total: dict[str, int] = {}
        for seen in self._batches.get(step, []):
            for name, n in seen.get.items():
                total[name] = total.get(name, 0) + n
        if self.report and step in self._batches:
            self.report(step, total)
        return total

    def watch_stream(self, df: DataFrame, step: str, **counts: Column) -> DataFrame:
        name = f"{step}-{uuid.uuid4().hex}"
        self._streams[name] = (step, {})
        if self._listener is None:
            self._listener = _Listener(self)
            self.spark.streams.addListener(self._listener)
        return df.observe(name, *[c.alias(n) for n, c in counts.items()])

    def streamed(self, step: str) -> dict[str, int]:
        """The counts of the step's stream so far."""
        total: dict[str, int] = {}
        with self._lock:
            for of, counts in self._streams.values():
                if of == step:
                    for name, n in counts.items():
                        total[name] = total.get(name, 0) + n
        return total

    def _add(self, run: str, batch: int, metrics: dict) -> None:
        for name, row in metrics.items():
            if name not in self._streams or (run, batch, name) in self._seen:
                continue
            with self._lock:
                self._seen.add((run, batch, name))
                step, counts = self._streams[name]
                for k, n in row.asDict().items():
                    counts[k] = counts.get(k, 0) + (n or 0)
            if self.report:
                self.report(step, row.asDict())

    def close(self) -> None:
        if self._listener is not None:
            self.spark.streams.removeListener(self._listener)
            self._listener = None


class _Listener(StreamingQueryListener):
    def __init__(self, progress: Progress) -> None:
        self.progress = progress

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.progress._add(str(event.progress.runId), event.progress.batchId, event.progress.observedMetrics)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
