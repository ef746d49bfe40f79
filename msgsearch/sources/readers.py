"""Reading exports and feeds of raw messages, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import ENTITY, RAW_MESSAGE, REQUEST, SESSION
from .paged import FORMAT, PagedExport

FORMATS = ("parquet", "json", "csv", "orc")
CORRUPT = "_corrupt_record"


def _reader(source, schema: T.StructType, fmt: str, options: dict):
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt in ("json", "csv"):
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    return source.schema(schema).format(fmt).options(**options)


def read_messages(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", **options
) -> DataFrame:
    """Raw messages of one or many export files or folders; the schema is fixed, not inferred."""
    return _reader(spark.read, RAW_MESSAGE, fmt, options).load(path)


def stream_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None, **options
) -> DataFrame:
    """The same as an unbounded source that picks up files as they arrive."""
    if max_files:
        options["maxFilesPerTrigger"] = max_files
    return _reader(spark.readStream, RAW_MESSAGE, fmt, options).load(path)


def stream_requests(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None, **options
) -> DataFrame:
    if max_files:
        options["maxFilesPerTrigger"] = max_files
    return _reader(spark.readStream, REQUEST, fmt, options).load(path)


def read_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """Raw messages of an export in pages (see :mod:`sources.paged`), with unparsable lines."""
    spark.dataSource.register(PagedExport)
    return _paged_messages(spark.read.format(FORMAT).options(path=path, **options).load())


def stream_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same as an unbounded source; its offset is the number of pages of each chat."""
    spark.dataSource.register(PagedExport)
    return _paged_messages(spark.readStream.format(FORMAT).options(path=path, **options).load())


def _paged_messages(lines: DataFrame) -> DataFrame:
    """Parsed lines; where a line does not name its account or chat, its folder does."""
    schema = T.StructType([*RAW_MESSAGE.fields, T.StructField(CORRUPT, T.StringType(), True)])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.select("account", "chat", F.from_json("line", schema, how).alias("m")).select("account", "chat", "m.*")
    return parsed.withColumns(
        {
            "session_name": F.coalesce("session_name", "account"),
            "chat_id": F.coalesce("chat_id", F.col("chat").try_cast("bigint")),
        }
    ).drop("account", "chat")


def read_entities(spark: SparkSession, path, fmt: str = "parquet", **options) -> DataFrame:
    return _reader(spark.read, ENTITY, fmt, options).load(path)


def read_sessions(spark: SparkSession, path, fmt: str = "json", **options) -> DataFrame:
    return _reader(spark.read, SESSION, fmt, options).load(path)


def read_requests(spark: SparkSession, path, fmt: str = "parquet", **options) -> DataFrame:
    return _reader(spark.read, REQUEST, fmt, options).load(path)


def corrupt_rows(raw: DataFrame) -> DataFrame:
    """Records the reader could not parse, as rejects."""
    if CORRUPT not in raw.columns:
        return raw.sparkSession.createDataFrame([], "reason string, payload string")
    return raw.filter(F.col(CORRUPT).isNotNull()).select(
        F.lit("unparsable").alias("reason"), F.col(CORRUPT).alias("payload")
    )
