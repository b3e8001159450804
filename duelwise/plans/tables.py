"""Descriptive tables over boxscores and match results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import params
from ..functions import interval_label, per_minute, utc_seconds
from ..operators.ranking import percent_rank_by
from ..operators.reshape import gather


def box_stats(
    boxscores: DataFrame, match_info: DataFrame, mode: str | None = None,
    min_time_s: float = params.MIN_TIME_S,
) -> DataFrame:
    """Kill-death ratio, time and rates per player, as rows with percent ranks."""
    matches = match_info if mode is None else match_info.filter(F.col("mode") == mode)
    kills, deaths = F.sum("kills"), F.sum("deaths")
    seconds = F.sum("duration_ms") / 1000
    table = (
        boxscores.join(matches.select("match_id", "duration_ms"), "match_id")
        .groupBy("name")
        .agg(
            F.try_divide(kills, deaths).alias("kd"),
            seconds.alias("time_s"),
            per_minute(kills, seconds).alias("kpm"),
            per_minute(kills + deaths, seconds).alias("epm"),
        )
        .filter(F.col("time_s") > min_time_s)
    )
    return percent_rank_by(gather(table, ["name"], ["kd", "time_s", "kpm", "epm"]), "stat")


def match_details(
    match_info: DataFrame, match_scores: DataFrame, match_id: str | None = None
) -> DataFrame:
    """Mode, map, length and both teams' results of one match, or of all."""
    if match_id is not None:
        match_info = match_info.filter(F.col("match_id") == match_id)
    return match_info.select("match_id", "mode", "map", "duration_ms", "rounds").join(
        match_scores.select("match_id", F.col("name").alias("team"), "score", "is_victor"),
        "match_id",
    )


def win_by_differential(
    plus_minus: DataFrame, low: int = params.BIN_LOW, high: int = params.BIN_HIGH
) -> DataFrame:
    """Share of wins and number of team-matches per unit of kill difference."""
    return (
        plus_minus.withColumn("bin", interval_label(F.col("pm"), low, high))
        .groupBy("bin")
        .agg(F.avg(F.col("is_victor").cast("int")).alias("win_pct"), F.count(F.lit(1)).alias("n"))
    )


def season_of(start: Column, seasons=params.SEASONS) -> tuple[Column, Column]:
    """Title and number of the first season that ends after ``start``, in epoch seconds UTC."""
    title, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for end, name, year in reversed(seasons):
        inside = start < F.unix_date(F.lit(end).cast("date")).cast("long") * 86400
        title, number = F.when(inside, name).otherwise(title), F.when(inside, year).otherwise(number)
    return title, number


def with_season(boxscores: DataFrame, match_info: DataFrame) -> DataFrame:
    title, number = season_of(F.col("start_time_s"))
    return boxscores.join(match_info, "match_id", "left").withColumns(
        {"title": title, "year_no": number, "start_time": utc_seconds(F.col("start_time_s"))}
    )


def season_stats(boxscores: DataFrame, match_info: DataFrame) -> DataFrame:
    """Kills, deaths, rounds, matches and ratio by season, its title, mode and player."""
    return (
        with_season(boxscores, match_info)
        .groupBy("year_no", "title", "mode", F.lower("name").alias("player"))
        .agg(
            F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"),
            F.sum("rounds").alias("rounds"), F.count(F.lit(1)).alias("n"),
        )
        .withColumn("kd", F.try_divide(F.col("kills"), F.col("deaths")))
    )


def season_games(stats: DataFrame) -> DataFrame:
    return stats.groupBy("year_no").agg(F.sum("n").alias("n"))


def year_over_year(
    stats: DataFrame, min_games: int = params.MIN_SEASON_GAMES, mode: str | None = None
) -> DataFrame:
    """Each player's value of a statistic in a mode beside that of the next season, if played."""
    if mode is not None:
        stats = stats.filter(F.col("mode") == mode)
    rates = stats.filter(F.col("n") > min_games).withColumn(
        "kpr", F.try_divide(F.col("kills"), F.col("rounds"))
    )
    rows = gather(rates, ["year_no", "mode", "player"], ["kd", "kpr"], "name")
    seasons = Window.partitionBy("player", "name", "mode").orderBy("year_no")
    follows = F.lead("year_no").over(seasons) == F.col("year_no") + 1
    return rows.withColumn("next_year", F.when(follows, F.lead("value").over(seasons)))


def year_over_year_corr(
    stats: DataFrame, min_games: int = params.MIN_SEASON_GAMES, mode: str | None = None
) -> DataFrame:
    """Correlation of each statistic with its next season, over complete pairs."""
    pairs = year_over_year(stats, min_games, mode)
    both = F.col("value").isNotNull() & F.col("next_year").isNotNull()
    return pairs.filter(both).groupBy("name").agg(F.corr("value", "next_year").alias("cor"))
