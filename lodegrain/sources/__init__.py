"""Boundaries: where untyped data enters, and where typed data leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, column: str = "json") -> DataFrame:
    """One row a line: its text as `raw`, and as a variant; lines that are no JSON have a null variant."""
    return spark.read.text(path).select(F.col("value").alias("raw"), F.try_parse_json("value").alias(column))


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """A CSV file with all columns as strings, as nothing is inferred; an empty cell is null."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=header)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def parse_json(frame: DataFrame, column: str, into: str = "json") -> DataFrame:
    """Parse a text column once to a variant."""
    return frame.withColumn(into, F.try_parse_json(column))


def write(frame: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple = ()) -> None:
    writer = frame.write.format(kind).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_jdbc(frame: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    frame.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()
