"""Folders that grow, read as streams: sessions are filtered, turned into chat records and counted; keyed records are
brought up to date batch by batch.

Bounded inputs need none of this; it serves corpora that are still being made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import chat
from ..operators.filters import is_completed
from ..schemas import DIALOGUE_SESSION
from ..sources.progress import Progress


def session_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(DIALOGUE_SESSION).option("maxFilesPerTrigger", max_files).json(folder)


def sft_stream(sessions: DataFrame, system: str, out: str, checkpoint: str, progress: Progress | None = None) -> StreamingQuery:
    """Appends the chat records of completed sessions to ``out``; each input file is used exactly once. ``progress`` counts
    the sessions that were read, and those that were completed, as step ``sft``."""
    if progress:
        sessions = progress.watch_stream(sessions, "sft", read=F.count("*"), completed=F.count_if(is_completed(F.col("is_completed"))))
    records = sessions.where(is_completed(F.col("is_completed"))).select(
        "source_id", chat.chat_messages(system, F.col("problem"), F.col("conversation")).alias("messages")
    )
    return records.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def emotion_stream(sessions: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Running counts of the learners' states over all sessions so far, in a memory table."""
    turns = sessions.select(F.explode("conversation").alias("t")).where("t.role = 'teacher'")
    counts = turns.groupBy(F.coalesce("t.student_emotion", F.lit("Unknown")).alias("emotion")).count()
    return counts.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


# --- keyed records that arrive in batches -----------------------------------


def record_stream(spark: SparkSession, folder: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    """JSON-lines records of a folder that grows, with a declared schema that has ``pos``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("mode", "FAILFAST").json(folder)


def last_wins_stream(records: DataFrame, key: Column, out: str, checkpoint: str, pos: str = "pos") -> StreamingQuery:
    """Keeps the last record of each key, at the first one's place, over all batches so far.

    The state holds one row a key. A batch's changed keys are written to a folder that
    is named after the batch, over what an attempt that failed left there: a batch that is
    run again after a crash changes nothing, and batches only cost what they change.
    ``read_last_wins`` merges the folders. Records of a key may come in any order: the
    largest ``pos`` wins."""
    row = F.struct(*[F.col(c) for c in records.columns])
    kept = records.groupBy(key.alias("key")).agg(F.max_by(row, F.col(pos)).alias("row"), F.min(pos).alias("place"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return stream.foreachBatch(write).start()


def read_last_wins(spark: SparkSession, out: str) -> DataFrame:
    """(key, place, the record's columns): of each key, what the newest batch that changed it wrote. Combined before the shuffle."""
    newest = spark.read.parquet(out).groupBy("key").agg(F.max_by(F.struct("row", "place"), F.col("batch")).alias("s"))
    return newest.select("key", "s.place", "s.row.*")


def batches_stream(rows: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Appends transformed batches, each to a folder named after it, so that a batch that is run again replaces itself.
    Unlike a file sink, ``transform`` may use all that batches may, and the folders need no log of the stream to be read."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
