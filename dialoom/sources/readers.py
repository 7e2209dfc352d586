"""Sources. Schemas are declared; a malformed record fails the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators.assign import last_wins, record_key, small_side
from ..schemas import RAW_PROBLEM
from .scratch import Scratch

#: Parse modes of the JSON functions: fail on malformed records, keep quotes strict.
STRICT = {"mode": "FAILFAST", "allowSingleQuotes": "false"}


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of JSON-lines files with ``pos``, the number of the record among all non-blank lines.

    Lines are numbered inside each split of a file; only one count a split is
    shuffled, and the lines themselves stay where they were read. So the files are
    read twice: for the counts, which are written, and for the records.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
    )
    lines = lines.where(~F.col("value").rlike("^(?U)\\s*$")).withColumn("_line", F.monotonically_increasing_id())
    splits = lines.groupBy("_file", "_start").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    splits = Scratch(spark, "jsonl").write(splits, "splits")
    placed = lines.join(small_side(splits), ["_file", "_start"], "left")
    # a split that the second read cut elsewhere would have no place: fail, never lose lines
    place = F.col("_before") + F.col("_line") - F.col("_first")
    pos = F.when(place.isNotNull(), place).otherwise(F.raise_error(F.lit("the files changed while they were read")).cast("long"))
    record = F.from_json("value", schema, STRICT)
    return placed.select(pos.cast("long").alias("pos"), record.alias("_r")).select("pos", "_r.*")


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file that holds one JSON array of records, on any number of lines, with ``ord``. For small dimensions such as profiles."""
    whole = spark.read.text(path, wholetext=True)
    records = F.from_json("value", ArrayType(schema), STRICT)
    return whole.select(F.posexplode(records).alias("ord", "_r")).select(F.col("ord").cast("long").alias("ord"), "_r.*")


def read_prompt(spark: SparkSession, path: str) -> str:
    """A whole prompt file, from any store that Spark knows. A missing file, a folder, or bytes that are no UTF-8 are errors."""
    source = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(source):
        raise FileNotFoundError(f"there is no prompt at {path}")
    if not store.getFileStatus(source).isFile():
        raise IsADirectoryError(f"{path} is a folder, not a prompt")
    stream = store.open(source)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def require(spark: SparkSession, *paths: str) -> None:
    """Fails, naming all of them, where one of a step's inputs is missing, before anything is read or called."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing input: {', '.join(missing)}")


def read_parquet_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of Parquet files with ``pos``: files in the order of their paths, rows in the order of each file.

    A row's place in its file comes with the scan, whatever splits and row groups the file is read by; how many rows the
    files before it hold is a sum over one row a file. A column ``pos`` of the files is replaced."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    placed = rows.drop("pos").withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    # no column of the data is read for this: rows are counted
    files = rows.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    files = Scratch(spark, "parquet").write(files, "files")
    found = placed.join(small_side(files), "_file", "left")
    place = F.col("_before") + F.col("_row")
    pos = F.when(place.isNotNull(), place).otherwise(F.raise_error(F.lit("the files changed while they were read")).cast("long"))
    return found.select(pos.alias("pos"), *[c for c in rows.columns if c != "pos"])


def read_problems(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    """A problem corpus (``jsonl`` or ``parquet``) with positions and the defaults of missing fields; columns that Parquet
    files don't have count as missing in every row."""
    rows = read_jsonl(spark, path, RAW_PROBLEM) if kind == "jsonl" else read_parquet_rows(spark, path)
    defaults = {"problem": "", "solution": "", "type": "unknown", "level": "unknown"}
    return rows.select("pos", *[F.coalesce(F.col(c), F.lit(d)).alias(c) if c in rows.columns else F.lit(d).alias(c) for c, d in defaults.items()])


def read_keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records by id, else source id: the last one of a key wins, at the place of the first."""
    rows = read_jsonl(spark, path, schema)
    return last_wins(rows, record_key(columns=rows.columns))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))
