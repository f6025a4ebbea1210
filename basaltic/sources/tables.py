"""The parquet tables the queries run on."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; parquet carries its own schema, so nothing is inferred from rows."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
