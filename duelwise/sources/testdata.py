"""The four input tables, derived from the generic ``events`` table of the test data.

``events`` (event_id, user_id, event_type, value) becomes a feed by integer arithmetic:
one hundred consecutive events are a match of eight seats, four a side. Coefficient
tables, which a user gets from the model jobs, are derived from the feed here as observed
odds, so that the rating queries can be checked in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feed, state, trades, xkill
from ..operators.reshape import unfold
from .readers import read_table, roster_of

# Schema of the given table.
EVENTS = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
          "value double, props string")

SEATS = 8
POOL = 23
PLAYERS = sorted(f"PLAYER{i}" for i in range(POOL))

# First second of each season's matches.
SEASON_STARTS = (1485907200, 1517443200, 1548979200)


def _player(seat: Column) -> Column:
    return F.concat(F.lit("PLAYER"), ((F.col("m") + 3 * seat) % POOL).cast("string"))


def _match() -> Column:
    return F.concat(F.lit("M"), F.col("m").cast("string")).alias("match_id")


@dataclass
class Feed:
    """Input tables and shared intermediate frames of one test-data folder."""

    spark: SparkSession
    path: str

    @cached_property
    def table(self) -> DataFrame:
        """The generic table; columns that a query does not use are pruned from the scan."""
        return read_table(self.spark, f"{self.path}/events.parquet", EVENTS)

    @cached_property
    def raw(self) -> DataFrame:
        cents = F.round(F.col("value") * 100).cast("long")
        base = self.table.select(
            F.expr("event_id div 100").alias("m"),
            (F.col("event_id") % 100).alias("rn"),
            F.when(F.col("event_type") == "signup", "spawn").otherwise("death").alias("type"),
            (F.col("user_id") % SEATS).alias("vs"),
            "event_id",
            cents.alias("c"),
        )
        other_side = F.when(F.col("vs") < 4, 4).otherwise(0)
        return base.select(
            "m", "rn", "type", "vs",
            (F.col("rn") * 2500 + F.col("c") % 2500).alias("time_ms"),
            (other_side + (F.col("event_id") * 7 + F.col("c")) % 4).alias("ks"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.raw.select(
            _match(), "time_ms", "type", _player(F.col("vs")).alias("id"),
            _player(F.col("ks")).alias("attacker_id"), "rn",
        )

    @cached_property
    def match_info(self) -> DataFrame:
        season = F.element_at(
            F.array(*[F.lit(s).cast("long") for s in SEASON_STARTS]),
            (F.expr("m div 3") % 3 + 1).cast("int"),
        )
        search = F.col("m") % 3 == 0
        return self.table.select(F.expr("event_id div 100").alias("m")).distinct().select(
            _match(),
            F.when(search, "Search").otherwise("Hardpoint").alias("mode"),
            F.concat(F.lit("MAP"), (F.col("m") % 4).cast("string")).alias("map"),
            F.lit(250000).cast("long").alias("duration_ms"),
            F.when(search, 11).otherwise(1).alias("rounds"),
            (season + 3600 * F.col("m")).alias("start_time_s"),
        )

    @cached_property
    def _seats(self) -> DataFrame:
        """Kills and deaths of every seat: one aggregate per match, then eight rows."""
        death = F.col("type") == "death"
        counts = [
            F.count_if(death & (F.col(column) == seat)).alias(f"{column}{seat}")
            for column in ("ks", "vs") for seat in range(SEATS)
        ]
        rows = F.explode(F.array(*[
            F.struct(F.lit(seat).alias("seat"), F.col(f"ks{seat}").alias("kills"),
                     F.col(f"vs{seat}").alias("deaths"))
            for seat in range(SEATS)
        ]))
        per_match = self.raw.groupBy("m").agg(*counts)
        return per_match.select("m", rows.alias("s")).select("m", "s.*")

    @cached_property
    def boxscores(self) -> DataFrame:
        return self._seats.select(
            _match(), _player(F.col("seat")).alias("name"),
            F.when(F.col("seat") < 4, "A").otherwise("B").alias("team"),
            F.col("kills").cast("int"), F.col("deaths").cast("int"),
            F.lit(0).alias("snd_firstbloods"), F.lit(0).alias("snd_firstdeaths"),
        )

    @cached_property
    def match_scores(self) -> DataFrame:
        side = F.col("seat") < 4
        totals = self._seats.groupBy("m").agg(
            F.sum(F.when(side, F.col("kills")).otherwise(0)).alias("a"),
            F.sum(F.when(~side, F.col("kills")).otherwise(0)).alias("b"),
        )
        a_wins = F.col("a") - F.col("b") + F.col("m") * 37 % 21 - 10 > 0
        teams = F.explode(F.array(
            F.struct(F.lit("A").alias("name"), F.col("a").alias("k"), a_wins.alias("is_victor")),
            F.struct(F.lit("B").alias("name"), F.col("b").alias("k"), (~a_wins).alias("is_victor")),
        ))
        return totals.select("m", teams.alias("t")).select(
            _match(), "t.name", (F.col("t.k") + 100).cast("int").alias("score"), "t.is_victor"
        )

    # Shared steps of the analysis.

    @cached_property
    def roster(self) -> DataFrame:
        return roster_of(self.boxscores)

    @cached_property
    def deaths(self) -> DataFrame:
        return feed.mode_deaths(self.events, self.match_info, keep=("rn",))

    @cached_property
    def sequence(self) -> DataFrame:
        return feed.event_sequence(self.deaths, "rn")

    @cached_property
    def long(self) -> DataFrame:
        return feed.engagement_long(self.sequence)

    @cached_property
    def steps(self) -> DataFrame:
        return feed.engagements(self.sequence)

    @cached_property
    def outcomes(self) -> DataFrame:
        return trades.trade_outcomes(self.long)

    @cached_property
    def alive(self) -> DataFrame:
        return state.alive_flags(state.event_roster(self.sequence, self.roster))

    @cached_property
    def states(self) -> DataFrame:
        return state.manpower_state(self.alive)

    @cached_property
    def pairs(self) -> DataFrame:
        return xkill.xkill_pairs(feed.engagements(self.sequence, gap_cap_ms=30000))

    @cached_property
    def state_outcomes(self) -> DataFrame:
        """Trade outcomes of the feed with its states, which stay on the rows."""
        return trades.trade_outcomes(feed.engagement_long(self.states))

    @cached_property
    def state_scores(self) -> DataFrame:
        pairs = xkill.xkill_pairs(feed.engagements(self.states, gap_cap_ms=30000))
        return xkill.xkill_closed_form(pairs)

    # Stand-ins for fitted coefficients, as observed odds with one added to each count.

    @cached_property
    def skill(self) -> DataFrame:
        kills = F.count_if(F.col("type") == feed.KILLER)
        odds = (kills + 1) / (F.count(F.lit(1)) - kills + 1)
        return self.long.groupBy(F.col("player").alias("name")).agg(odds.alias("odds")).select(
            "name", F.log("odds").alias("estimate"), "odds",
            (F.col("odds") / (1 + F.col("odds"))).alias("prob"),
        )

    @cached_property
    def trade_terms(self) -> DataFrame:
        tried = F.coalesce(F.col("trade_att"), F.lit(False))
        rows = self.outcomes.select(
            F.col("attacker_id").alias("KILLER"), F.col("id").alias("DEAD"), tried.alias("hit")
        )
        return _observed_odds(rows, ["KILLER", "DEAD"]).select(
            F.concat_ws("_", "player", "type").alias("term"), "estimate"
        )

    @cached_property
    def won_roles(self) -> DataFrame:
        rows = self.outcomes.filter("trade_att").select(
            F.col("attacker_id").alias("P1"), F.col("id").alias("P2"),
            F.col("other_player").alias("P3"), F.col("trade_win").alias("hit"),
        )
        return _observed_odds(rows, ["P1", "P2", "P3"])

    @cached_property
    def pace_coefs(self) -> DataFrame:
        times = state.player_time_alive(self.alive)
        league = times.agg(F.sum("engs") / F.sum("toi")).scalar()
        return times.select(
            "player_id", F.col("type").alias("name"),
            (F.try_divide(F.col("engs"), F.col("toi")) / league).alias("value"),
        )

    @cached_property
    def quality_coefs(self) -> DataFrame:
        return self.alive.groupBy("player_id", F.col("type").alias("name")).agg(
            (F.avg("alive") - 0.75).alias("value")
        )


def _observed_odds(rows: DataFrame, roles: list[str]) -> DataFrame:
    hits = F.count_if(F.col("hit"))
    return unfold(rows, ["hit"], roles, "type", "player").groupBy("player", "type").agg(
        ((hits + 1) / (F.count(F.lit(1)) - hits + 1)).alias("estimate")
    )
