"""Man-power: which roster players are alive at each event, and for how long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from .feed import KILLER, VICTIM
from .reshape import role_terms, spread, sum_matrix
from .scan import block_of, by_event, event_keys, scan

EVENT = ["match_id", "event_id", "time_ms", VICTIM, KILLER]


def with_roster(df: DataFrame, roster: DataFrame) -> DataFrame:
    """Add the match's roster to each row as an array of (player_id, team).

    One small array per match is joined on the match, on which a numbered feed is already
    partitioned; with blocks the array is first copied to each block of its match.
    """
    seats = roster.select(F.col("match_id").alias("r_match"), F.struct(
        "player_id", "team").alias("seat"))
    packed = seats.groupBy("r_match").agg(F.collect_list("seat").alias("roster"))
    block = block_of(df)
    same_match = F.col("match_id") == F.col("r_match")
    if block is None:
        return df.join(packed, same_match, "left").drop("r_match")
    blocks = df.select(F.col("match_id").alias("b_match"), block.alias("r_block")).distinct()
    packed = blocks.join(packed, F.col("b_match") == F.col("r_match"))
    return df.join(packed, same_match & (block == F.col("r_block")), "left").drop(
        "r_match", "b_match", "r_block")


def team_of(player: str) -> Column:
    """The team of a player column, looked up in the packed roster; NULL if not there."""
    return F.get(
        F.transform(
            F.filter("roster", lambda seat: seat["player_id"].eqNullSafe(F.col(player))),
            lambda seat: seat["team"],
        ),
        F.lit(0),
    )


def event_roster(sequence: DataFrame, roster: DataFrame) -> DataFrame:
    """Every event with every player of the match, FOR or AGAINST the killer's team.

    A killer who is missing or not on the roster leaves everyone AGAINST. Further columns of
    the feed are kept.
    """
    event = sequence.columns
    return (
        with_roster(sequence, roster)
        .withColumn("killer_team", team_of(KILLER))
        .select(*event, "killer_team", F.explode_outer("roster").alias("seat"))
        .select(
            *event,
            F.col("seat.player_id").alias("player_id"),
            F.when(F.col("seat.team") == F.col("killer_team"), F.lit("FOR"))
            .otherwise(F.lit("AGAINST"))
            .alias("type"),
        )
    )


def alive_flags(rows: DataFrame, respawn_ms: int = params.RESPAWN_MS) -> DataFrame:
    """1 if the player can act at the event: later than every earlier time they were back.

    A player is back ``respawn_ms`` after an event in which they fell, and at once after
    any other. The comparison is strict, from 0.
    """
    back = F.col("time_ms") + F.when(F.col(VICTIM) == F.col("player_id"), respawn_ms).otherwise(0)
    marked = scan(
        rows.withColumn("time_back", back), ["match_id", "player_id"], ["event_id"],
        peak={"back_before": F.col("time_back")},
    )
    before = F.greatest(F.lit(0), F.coalesce(F.col("back_before"), F.lit(0)))
    return marked.withColumn("alive", (before < F.col("time_back")).cast("int")).drop(
        "time_back", "back_before"
    )


def alive_matrix(alive: DataFrame, players: list[str]) -> DataFrame:
    """One ``player_SIDE`` column per player: whether alive on that side, 0 if not there."""
    return sum_matrix(
        alive, ["match_id", "event_id", "time_ms", VICTIM], F.concat_ws("_", "player_id", "type"),
        F.col("alive"), role_terms(players, ["AGAINST", "FOR"]),
    )


def trader_role() -> Column:
    """DEAD or KILLER for the players of the event, else the side of the roster row."""
    return (
        F.when(F.col("player_id") == F.col(VICTIM), "DEAD")
        .when(F.col("player_id") == F.col(KILLER), "KILLER")
        .otherwise(F.col("type"))
    )


def trader_roles(alive: DataFrame) -> DataFrame:
    """Event-roster rows with role DEAD, KILLER or AGAINST; the killer's team-mates go."""
    return alive.withColumn("type", trader_role()).filter(F.col("type") != "FOR")


def trader_matrix(alive: DataFrame, players: list[str]) -> DataFrame:
    """Who could trade: one ``player_ROLE`` column with the alive flag."""
    return sum_matrix(
        trader_roles(alive), ["match_id", "event_id"], F.concat_ws("_", "player_id", "type"),
        F.col("alive"), role_terms(players, ["AGAINST", "DEAD", "KILLER"]),
    )


def manpower_state(
    alive: DataFrame, terms: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Players alive for and against the killer at each event, as ``AvB`` and difference.

    An aggregate per event on the match's partitioning: nothing is pivoted or shuffled.
    Both ids stay, so that engagement features can be computed on the result and carry the
    state with them. ``terms`` is a text column of the roster row; those that are not NULL
    are gathered per event. ``keep`` names further columns of the event.
    """
    def side(name: str):
        return F.sum(F.when(F.col("type") == name, F.col("alive")).otherwise(0))

    gathered = [] if terms is None else [F.collect_list(terms).alias("terms")]
    return (
        by_event(alive, *EVENT, *keep)
        .agg(side("FOR").alias("for_alive"), side("AGAINST").alias("against_alive"), *gathered)
        .drop("in_block")
        .withColumns({
            "state": F.concat(F.col("for_alive").cast("string"), F.lit("v"),
                              F.col("against_alive").cast("string")),
            "adv": F.col("for_alive") - F.col("against_alive"),
        })
    )


def states_of(
    sequence: DataFrame, roster: DataFrame, respawn_ms: int = params.RESPAWN_MS
) -> DataFrame:
    """Man-power state of every event of a numbered feed."""
    return manpower_state(alive_flags(event_roster(sequence, roster), respawn_ms))


def state_shifts(states: DataFrame, start: str = params.START_STATE) -> DataFrame:
    """The first event of each run of equal states, numbered by changes since ``start``."""
    rows = scan(
        states, ["match_id"], ["event_id"], previous={"prev_state": "state"},
        changes={"shift_index": ("state", start)},
    )
    first = F.col("prev_state").isNull() | (F.col("state") != F.col("prev_state"))
    return rows.filter(first).drop("prev_state", "for_alive", "against_alive")


def engagement_pace(states: DataFrame) -> DataFrame:
    """Time since the previous event of the match and the pace per minute that it means.

    The first event has no duration. ``model_ms`` is the duration for a survival model,
    where 0 ms counts as 1 ms.
    """
    rows = scan(states, ["match_id"], ["event_id"], previous={"prev_time": "time_ms"})
    duration = F.col("time_ms") - F.col("prev_time")
    return rows.select(
        *event_keys(states), *(["terms"] if "terms" in states.columns else []),
        duration.alias("duration"),
        F.try_divide(F.lit(60000.0), duration).alias("epm"),
        F.lit(1).alias("shot"),
        F.when(duration.isNotNull(), F.greatest(duration, F.lit(1))).alias("model_ms"),
    )


def event_lengths(sequence: DataFrame) -> DataFrame:
    """The feed with the time since the previous event, from 0 for the first."""
    rows = scan(sequence, ["match_id"], ["event_id"], previous={"prev_time": "time_ms"})
    gap = F.col("time_ms") - F.coalesce(F.col("prev_time"), F.lit(0))
    return rows.withColumn("event_len", gap).drop("prev_time")


def team_advantage(states: DataFrame, roster: DataFrame) -> DataFrame:
    """Both players of each event with the man-power advantage seen from their team.

    ``states`` is the feed with its states.
    """
    keys = ["match_id", "event_id"]
    event = with_roster(event_lengths(states), roster)
    sides = F.explode(
        F.array(
            F.struct(F.lit(VICTIM).alias("type"), F.lit(0).alias("role_ord"),
                     F.col(VICTIM).alias("player"), team_of(VICTIM).alias("team"),
                     (-F.col("adv")).alias("adv")),
            F.struct(F.lit(KILLER).alias("type"), F.lit(1).alias("role_ord"),
                     F.col(KILLER).alias("player"), team_of(KILLER).alias("team"),
                     F.col("adv").alias("adv")),
        )
    )
    rows = event.select(*keys, "time_ms", "event_len", sides.alias("side")).select(
        *keys, "time_ms", "event_len", "side.*"
    )
    rows = scan(
        rows, ["match_id", "team"], ["event_id", "role_ord"], previous={"previous_adv": "adv"}
    )
    return rows.withColumn("previous_adv", F.coalesce(F.col("previous_adv"), F.lit(0)))


def time_at_advantage(team_rows: DataFrame) -> DataFrame:
    """Milliseconds that each team of a match spent at each advantage."""
    return team_rows.groupBy("match_id", "team", "adv").agg(F.sum("event_len").alias("time"))


def advantage_levels(roster: DataFrame) -> list[int]:
    """All advantages that the largest side of any match allows."""
    sides = roster.groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("n"))
    most = sides.agg(F.max("n")).first()[0] or 0
    return list(range(-most, most + 1))


def time_at_advantage_wide(times: DataFrame, levels: list[int]) -> DataFrame:
    """One column per level; ``advantage_levels`` names all that can occur."""
    return spread(times, ["match_id", "team"], "adv", "time", levels)


def team_plus_minus(
    boxscores: DataFrame, match_scores: DataFrame, match_info: DataFrame | None = None,
    mode: str | None = None,
) -> DataFrame:
    """Engagements and kill difference of each team in a match, with score and victory."""
    if mode is not None:
        boxscores = boxscores.join(
            match_info.filter(F.col("mode") == mode).select("match_id"), "match_id"
        )
    kills, deaths = (F.coalesce(F.sum(c), F.lit(0)) for c in ("kills", "deaths"))
    return (
        boxscores.groupBy("match_id", "team")
        .agg((kills + deaths).alias("engs"), (kills - deaths).alias("pm"))
        .join(
            match_scores.select("match_id", F.col("name").alias("team"), "score", "is_victor"),
            ["match_id", "team"], "left",
        )
    )


def advantage_vs_score(wide_times: DataFrame, plus_minus: DataFrame) -> DataFrame:
    return wide_times.join(plus_minus, ["match_id", "team"], "left")


def match_with_difference(scored: DataFrame, pm: int) -> DataFrame:
    """The first match, by id, in which a team had this kill difference."""
    return scored.filter(F.col("pm") == pm).orderBy("match_id", "team").limit(1).select(
        "match_id", "team", "pm"
    )


def advantage_profile(times: DataFrame, match_id: str | None = None) -> DataFrame:
    """Time at each positive advantage, whatever its size; for one match or for all."""
    if match_id is not None:
        times = times.filter(F.col("match_id") == match_id)
    return times.filter(F.col("time").isNotNull() & (F.col("adv") > 0))


def advantage_timeline(
    team_rows: DataFrame, match_id: str | None = None, team: str | None = None
) -> DataFrame:
    """Running sum of a team's advantage through a match."""
    if match_id is not None:
        team_rows = team_rows.filter(F.col("match_id") == match_id)
    if team is not None:
        team_rows = team_rows.filter(F.col("team") == team)
    rows = scan(
        team_rows, ["match_id", "team"], ["event_id", "role_ord"],
        total={"cum_adv": F.col("adv")},
    )
    return rows.select(
        "match_id", "event_id", "type", "team", "time_ms", "cum_adv"
    )


def player_time_alive(alive: DataFrame) -> DataFrame:
    """Milliseconds alive and events seen, per player and side.

    Time alive is the time since the previous event, counted if the player is alive.
    """
    rows = scan(
        alive, ["match_id", "player_id"], ["event_id"], previous={"prev_time": "time_ms"}
    )
    gap = F.col("time_ms") - F.coalesce(F.col("prev_time"), F.lit(0))
    return rows.groupBy("player_id", "type").agg(
        F.sum(F.when(F.col("alive") == 1, gap).otherwise(0)).alias("toi"),
        F.count(F.lit(1)).alias("engs"),
    )


def eligible_players(roster: DataFrame, min_games: int = params.MIN_GAMES) -> DataFrame:
    """Players with more than ``min_games`` roster rows."""
    return (
        roster.groupBy("player_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_games)
    )


def engagement_rate(boxscores: DataFrame, match_info: DataFrame, mode: str = params.MODE) -> DataFrame:
    """Kills per second of each match, averaged over the matches of a mode."""
    per_match = (
        boxscores.join(
            match_info.filter(F.col("mode") == mode).select("match_id", "duration_ms"), "match_id"
        )
        .groupBy("match_id")
        .agg(F.try_divide(F.sum("kills"), F.avg(F.col("duration_ms") / 1000)).alias("rate"))
    )
    return per_match.agg(F.avg("rate").alias("ms_per_eng"))
