"""Reading tables so that every core gets work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table."""
    return spark.read.parquet(path)


def read_texts(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """Read a Parquet table whose rows are expensive to process.

    ``spread`` deals the rows over two tasks per core if the files are cut into fewer parts than
    there are cores (files of a few large row groups).  That costs one shuffle of the texts,
    little beside scanning them with a few cores; a table with a part for every core, as any
    large one has, is read as it lies."""
    rows = read_table(spark, path)
    cores = spark.sparkContext.defaultParallelism
    if not spread or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(2 * cores)
