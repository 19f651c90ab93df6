"""Scan parameters and search entries."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from resalelens.settings import ScanConfig

SEARCH_SCHEMA = "keywords STRING, category STRING, state STRING, min_bid DOUBLE, max_bid DOUBLE"
CONFIG_SCHEMA = (
    "max_listings_per_search INT, your_city_state STRING, your_zip STRING, radius_miles DOUBLE, "
    "state STRING, max_bid DOUBLE, min_profit DOUBLE, max_daily_posts INT, "
    f"searches ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in SEARCH_SCHEMA.split(', '))}>>"
)


def config_table(spark: SparkSession, config: ScanConfig) -> DataFrame:
    return spark.createDataFrame([asdict(config)], CONFIG_SCHEMA)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of a config file, one row; the defaults if there is no file.

    Absent parameters take their default too.
    """
    defaults = asdict(ScanConfig())
    try:
        df = spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return config_table(spark, ScanConfig())
    return df.fillna({k: v for k, v in defaults.items() if k != "searches"})


def searches_of(config: DataFrame) -> DataFrame:
    """Search entries of a config, numbered in file order."""
    return (
        config.select(F.posexplode("searches").alias("search_id", "s"))
        .select("search_id", "s.*")
    )
