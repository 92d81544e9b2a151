"""Tables as streams: a filter or projection of the engine's grammar over files that keep arriving. Beyond the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import relational as rel


def follow(spark: SparkSession, folder: str, schema, where: str | None = None, items: tuple[str, ...] = ()) -> DataFrame:
    """A streaming DataFrame over the Parquet files of a folder, filtered and projected."""
    df = spark.readStream.schema(schema).parquet(folder)
    if where:
        df = rel.where(df, where)
    return rel.project(df, *items) if items else df


def append(stream: DataFrame, path: str, checkpoint: str):
    """Writes what has arrived so far, exactly once, and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
