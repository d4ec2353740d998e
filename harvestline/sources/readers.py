"""Reading tables, batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def batch_source(spark: SparkSession, folder: str, name: str,
                 schema: T.StructType | None = None) -> DataFrame:
    """A derived or dimension table; columns and filters are pushed to parquet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(table_path(folder, name))


def stream_source(spark: SparkSession, path: str, schema: T.StructType,
                  max_files: int = 64) -> DataFrame:
    """An append-only event table as a stream: a folder that gains files, taken as it is.

    A plain folder need not exist yet: it is made, so a stream can wait for its first file.
    As everywhere in Spark a path with glob signs is a pattern; one file is streamed by a
    pattern that fits it alone, see `one_file`.
    """
    if not set(path) & set("*?[{"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            files.mkdirs(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def one_file(path: str) -> str:
    """A pattern that fits this file or folder only: the file source wants a folder or pattern."""
    plain = path.rstrip("/")
    return f"{plain[:-1]}[{plain[-1]}]"


def with_instants(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as instants (UTC session), which watermarks require."""
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def json_event_decode(df: DataFrame, payload: str | Column, schema: T.StructType) -> DataFrame:
    """Typed rows from JSON event text whose timestamps are epoch microseconds."""
    wire = T.StructType([
        T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType)
                      else f.dataType, True)
        for f in schema.fields
    ])
    text = F.col(payload) if isinstance(payload, str) else payload
    decoded = df.select(F.from_json(text, wire).alias("event"))
    return decoded.select(*[
        (F.timestamp_micros(F.col(f"event.{f.name}"))
         if isinstance(f.dataType, T.TimestampType) else F.col(f"event.{f.name}")).alias(f.name)
        for f in schema.fields
    ])
