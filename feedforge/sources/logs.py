"""Reading interaction logs into the canonical table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedforge.functions.actions import ACTIONS
from feedforge.functions.coerce import blank_to_null, finalize_int, safe_float
from feedforge.operators.segments import asc, running
from feedforge.operators.split import first_users
from feedforge.session import written

# Column names of the log files.
ALIASES = {"uid": "user_id", "iid": "item_id"}
HISTORY_COLUMNS = tuple(f"hist_{i}" for i in range(1, 11))
INTEGER_COLUMNS = ("video_category", "watching_times", "gender", "age")
KNOWN_COLUMNS = (
    "user_id",
    "item_id",
    *ALIASES,
    "timestamp",
    *ACTIONS,
    "reading_duration",
    *INTEGER_COLUMNS,
    *HISTORY_COLUMNS,
)
CODECS = ("zstd", "snappy", "gzip", "brotli", "none")
# Files or splits whose offsets may be broadcast: three numbers each.
BROADCAST_ROWS = 1 << 20


class SourceNotFound(FileNotFoundError):
    """Neither a Parquet nor a CSV file exists for a scenario."""


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV as text; missing-field texts become null."""
    df = spark.read.option("header", True).option("nullValue", "\\N").csv(path)
    return df


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; unused columns are pruned by the later selection."""
    return spark.read.parquet(path)


def wanted_columns(columns: list[str]) -> list[str]:
    """Known columns among those of a header, in header order."""
    return [c for c in columns if c in KNOWN_COLUMNS]


def resolve(spark: SparkSession, folder: str, scenario: str) -> tuple[str, str]:
    """(format, path) of a scenario: Parquet first, then CSV."""
    for fmt, reader in (("parquet", scan_parquet), ("csv", scan_csv)):
        path = f"{folder.rstrip('/')}/{scenario}.{fmt}"
        try:
            reader(spark, path).schema
            return fmt, path
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise SourceNotFound(f"no {scenario}.parquet or {scenario}.csv in {folder}")


def number_rows(scan: DataFrame, name: str = "row_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Dense row number in file order, without moving rows.

    ``scan`` must be a plain file scan. One pass that reads no column counts the rows of every file and writes the
    counts; running totals over them give each file its offset. A Parquet row knows its place in its file, however the file is
    split; in other formats rows are placed in their split, so there the counts are per split. Offsets are joined by a hash of
    file name, length and time (and split). They are broadcast up to ``broadcast_rows`` of them, counted before; beyond
    that Spark chooses the join. The join is a left join and every place is held against the count: a row of a file or split
    that was not counted, or that is not as long as counted, fails the query and is never lost.
    """
    by = ["file_path", "file_size", "file_modification_time"]
    place = F.monotonically_increasing_id()
    if _knows_places(scan):
        place = F.col("_metadata.row_index")
    else:
        by += ["file_block_start", "file_block_length"]
    unit = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in by]
    placed = scan.select("*", F.xxhash64(*[F.col(f"_metadata.{c}") for c in by]).alias("_unit"), place.alias("_place"))
    counted = scan.select(*unit, place.alias("_place")).groupBy(*[f"_{c}" for c in by])
    sizes = counted.agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_begin"))
    sizes = written(sizes.withColumn("_unit", F.xxhash64(*[f"_{c}" for c in by])), "row-counts")
    units = sizes.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_unit").alias("different")).first()
    if units["rows"] != units["different"]:
        raise RuntimeError("two files have one hash; rename one of them")
    order = [asc(f"_{c}") for c in by if c in ("file_path", "file_block_start")]
    offsets = running(sizes, [], order, {"_before": ("sum", F.col("_n"))}, exclusive=True).select(
        "_unit", "_n", "_begin", F.coalesce("_before", F.lit(0)).alias("_before")
    )
    if units["rows"] <= broadcast_rows:
        offsets = F.broadcast(offsets)
    at = F.col("_place") - F.col("_begin")
    fits = F.coalesce((at >= 0) & (at < F.col("_n")), F.lit(False))
    changed = F.raise_error(F.lit("the files or their splits changed after their rows were counted")).cast("bigint")
    number = F.when(fits, F.col("_before") + at).otherwise(changed)
    joined = placed.join(offsets, "_unit", "left")
    return joined.withColumn(name, number).drop("_unit", "_place", "_n", "_begin", "_before")


def _knows_places(scan: DataFrame) -> bool:
    """Whether the format tells the place of a row in its file."""
    return "row_index" in scan.select("_metadata").schema["_metadata"].dataType.fieldNames()


def rename_aliases(df: DataFrame) -> DataFrame:
    """Short id names to full ones where the full one is absent."""
    for short, full in ALIASES.items():
        if short in df.columns and full not in df.columns:
            df = df.withColumnRenamed(short, full)
    return df


def valid_users(df: DataFrame) -> DataFrame:
    """Drop rows whose user id is not a number."""
    return df.where(F.col("user_id").try_cast("double").try_cast("bigint").isNotNull())


def _default_int(df: DataFrame, name: str, to: str) -> Column:
    if name not in df.columns:
        return F.lit(0).cast(to)
    return finalize_int(F.col(name), to)


def duration(df: DataFrame) -> Column:
    """Reading duration, else watching times, else 0."""
    present = [F.col(c).try_cast("double") for c in ("reading_duration", "watching_times") if c in df.columns]
    return F.coalesce(*present, F.lit(0.0))


def to_interactions(df: DataFrame) -> DataFrame:
    """Canonical interaction table from numbered raw rows (with ``row_id``).

    A log without timestamps uses the row number; missing columns become 0.
    """
    df = rename_aliases(df)
    df = df.withColumns({c: blank_to_null(F.col(c)) for c, t in df.dtypes if t == "string"})
    df = valid_users(df)
    ts = finalize_int(F.col("timestamp")) if "timestamp" in df.columns else F.col("row_id")
    history = [finalize_int(F.col(c)) for c in HISTORY_COLUMNS if c in df.columns]
    return df.select(
        F.col("row_id").cast("bigint").alias("row_id"),
        finalize_int(F.col("user_id")).alias("user_id"),
        _default_int(df, "item_id", "bigint").alias("item_id"),
        ts.cast("bigint").alias("ts_s"),
        *[_default_int(df, a, "int").alias(a) for a in ACTIONS],
        duration(df).alias("reading_duration"),
        *[_default_int(df, c, "int").alias(c) for c in INTEGER_COLUMNS],
        (F.array(*history) if history else F.array().cast("array<bigint>")).alias("hist_items"),
    )


def read_interactions(spark: SparkSession, path: str, fmt: str = "parquet", max_users: int | None = None) -> DataFrame:
    """A log file as the canonical table, optionally only its first users."""
    scan = (scan_csv if fmt == "csv" else scan_parquet)(spark, path)
    columns = wanted_columns(scan.columns)
    numbered = number_rows(scan).select("row_id", *columns)
    log = to_interactions(numbered)
    return log if max_users is None else first_users(log, max_users)


def load_scenario(spark: SparkSession, folder: str, scenario: str, max_users: int | None = None) -> DataFrame:
    """:func:`resolve`, then :func:`read_interactions`."""
    fmt, path = resolve(spark, folder, scenario)
    return read_interactions(spark, path, fmt, max_users)


def csv_to_parquet(spark: SparkSession, source: str, target: str, codec: str = "zstd", overwrite: bool = False) -> None:
    """Convert a CSV log to Parquet; an existing target is kept unless told otherwise."""
    if codec not in CODECS:
        raise ValueError(f"codec must be one of {', '.join(CODECS)}")
    log = scan_csv(spark, source)
    log = log.withColumns({c: blank_to_null(F.col(c)) for c in log.columns})
    typed = {}
    for name in log.columns:
        if name == "reading_duration":
            typed[name] = safe_float(F.col(name))
        elif name in KNOWN_COLUMNS:
            typed[name] = finalize_int(F.col(name))
    writer = log.withColumns(typed).write.mode("overwrite" if overwrite else "errorifexists")
    writer.option("compression", "uncompressed" if codec == "none" else codec).parquet(target)
