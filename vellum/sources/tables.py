"""Readers for the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; only Spark's reader touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by ``key`` over the session's shuffle partitions, four for each core at least.

    Rows that are small and of which much is made, as an image of each, would else be as few tasks as their file has pieces.
    The number is given, as adaptive execution would join up small partitions again.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(index, token) of a dictionary file, a token a line, numbered from 0 in the order of the lines; line ends go, spaces stay.

    A file is one text value here, as its lines' order is what numbers them.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return whole.select(F.posexplode(lines).alias("index", "token"))
