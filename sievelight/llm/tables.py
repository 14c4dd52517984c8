"""Reading input tables and cutting lineage with written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelight.session import shared_folder
from sievelight.sources.jobs import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder.

    Cuts the lineage so that a lost executor costs a reread, gives Catalyst the
    true size for its choice of joins, and runs the work above it only once.
    """
    ship_package(df.sparkSession)
    path = shared_folder(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` clashes with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
