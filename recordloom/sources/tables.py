"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "records audit_events anchor_facts compacted_records type_registry profile_budgets source_targets"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Offer every table of the directory to Spark SQL under its own name."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
