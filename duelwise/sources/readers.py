"""Readers and writers. Connection options always come from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the input tables and of the coefficient files.
SCHEMAS = {
    "events": "match_id string, time_ms bigint, type string, id string, attacker_id string",
    "match_info": "match_id string, mode string, map string, duration_ms bigint, rounds int, "
                  "start_time_s bigint",
    "boxscores": "match_id string, name string, team string, kills int, deaths int, "
                 "snd_firstbloods int, snd_firstdeaths int",
    "match_scores": "match_id string, name string, score int, is_victor boolean",
    "terms": "term string, estimate double, `std.error` double, statistic double, "
             "`p.value` double",
    "roles": "player string, type string, estimate double, `std.error` double, "
             "statistic double, `p.value` double",
    "skill": "name string, estimate double, odds double, prob double",
}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table. With a schema (a name of ``SCHEMAS`` or a text) no footer is read
    before the query runs.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(SCHEMAS.get(schema, schema))
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, **options: str) -> DataFrame:
    """A database table. Pass ``partitionColumn``, bounds and ``numPartitions`` as well, so
    that the table is read by many tasks; filters and projections are pushed down.
    """
    return spark.read.format("jdbc").options(**options).load()


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with header, in which ``NA`` means NULL."""
    reader = spark.read.option("header", True).option("nullValue", "NA")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(SCHEMAS.get(schema, schema)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with header, in which NULL is written as ``NA``."""
    df.write.option("header", True).option("nullValue", "NA").csv(path)


def roster_of(boxscores: DataFrame) -> DataFrame:
    """Match, player and team of every boxscore row."""
    return boxscores.select("match_id", F.col("name").alias("player_id"), "team")
