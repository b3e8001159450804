"""Trades: whether a kill is answered within a few seconds, by whom, and who wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from .feed import KILLER, VICTIM
from .ranking import league_mean, percent_rank_by
from .reshape import gather, presence_matrix, role_terms, unfold
from .scan import EVENT_COLUMNS, by_event, event_keys, scan


def trade_outcomes(long: DataFrame, trade_ms: int = params.TRADE_MS) -> DataFrame:
    """Every event with the killer's next engagement, if it answers this kill in time.

    The next row of the killer is always in the same life, so looking one row ahead
    gives what a join of the feed with itself on the previous kill would give, without
    a second shuffle. ``trade_win``: the killer was the victim of that engagement.
    """
    ahead = scan(
        long, ["match_id", "player"], ["event_id", "role_ord"], descending=True,
        previous={"next_time": "time_ms", "next_type": "type", "next_other": "other_player"},
    )
    answered = F.col("next_time") - F.col("time_ms") < trade_ms
    return ahead.filter(F.col("type") == KILLER).select(
        *event_keys(long, "time_ms"),
        F.col("victim").alias(VICTIM),
        F.col("player").alias(KILLER),
        F.when(answered, F.col("next_other")).alias("other_player"),
        F.when(answered, F.lit(True)).alias("trade_att"),
        F.when(answered, F.col("next_type") == VICTIM).alias("trade_win"),
    )


def was_traded(outcomes: DataFrame) -> DataFrame:
    """Every event and whether a trade was attempted on it."""
    return outcomes.select(
        "match_id", "event_id", "time_ms", VICTIM, KILLER,
        F.coalesce(F.col("trade_att"), F.lit(False)).alias("in_trade_eng"),
    )


def trades_only(outcomes: DataFrame) -> DataFrame:
    """Events with an attempted trade: killer, victim, follow-up opponent and result."""
    return outcomes.filter(F.col("trade_win").isNotNull()).select(
        *event_keys(outcomes, "time_ms"), VICTIM, KILLER,
        F.col(KILLER).alias("player"), "other_player",
        F.col("trade_att").alias("in_trade_eng"), F.col("trade_win").alias("traded"),
    )


def trade_engs(outcomes: DataFrame) -> DataFrame:
    """The killer of each answered kill, and whether they won the follow-up."""
    return outcomes.filter("trade_att").select(
        "match_id", "event_id", F.col(KILLER).alias("player"), (~F.col("trade_win")).alias("win")
    )


def trade_roles_long(trades: DataFrame) -> DataFrame:
    """Attempted trades by role: P1 the killer, P2 the victim, P3 the follow-up opponent."""
    ids = [*event_keys(trades), "traded"]
    roles = trades.select(
        *ids,
        F.col(KILLER).alias("P1"), F.col(VICTIM).alias("P2"), F.col("other_player").alias("P3"),
    )
    return unfold(roles, ids, ["P1", "P2", "P3"], "p", "player_id")


def trade_role_matrix(roles: DataFrame, players: list[str]) -> DataFrame:
    """One ``player_ROLE`` indicator per listed player and trade role."""
    return presence_matrix(
        roles, ["match_id", "event_id", "traded"],
        F.concat_ws("_", "player_id", "p"), role_terms(players, ["P1", "P2", "P3"]),
    )


def marked_trades(steps: DataFrame) -> DataFrame:
    """Rows outside the after-respawn window, with ``trade_kill``: exactly one player of
    the event is in a trade. The mark is taken over both rows of the event.
    """
    event = event_keys(steps)
    marks = by_event(steps, *event).agg(
        F.bool_or("in_trade_eng").alias("some"), F.bool_and("in_trade_eng").alias("every"),
        F.collect_list(
            F.struct("type", "player", "pdk", "last_kill_id", "in_trade_eng", "win")
        ).alias("rows"),
    )
    return (
        marks.select(
            *event, (F.col("some") & ~F.col("every")).alias("trade_kill"),
            F.explode("rows").alias("row"),
        )
        .select(*event, "row.*", "trade_kill")
        .filter(~F.col("pdk"))
    )


def xor_trades(steps: DataFrame) -> DataFrame:
    return marked_trades(steps).filter("trade_kill")


def non_trades(steps: DataFrame) -> DataFrame:
    return marked_trades(steps).filter(~F.col("trade_kill"))


def trade_triplets(steps: DataFrame, strict: bool = False) -> DataFrame:
    """Per one-sided trade: AGAINST just killed, TRADE is their opponent, DEAD fell before.

    DEAD is the victim of the previous kill. If the avenger has an older kill in the same
    life as well, both victims give a triplet; ``strict`` keeps the one of the trade only.
    TRADE and ``win`` are NULL where the avenger just respawned. The previous victim is
    carried on the row, so no join back to the earlier event is needed.
    """
    shown = ~F.col("pdk")
    event = event_keys(steps)
    counted = shown if not strict else shown & F.col("in_trade_eng")
    events = (
        by_event(steps, *event)
        .agg(
            F.bool_or("in_trade_eng").alias("some"),
            F.bool_and("in_trade_eng").alias("every"),
            F.max(F.when(F.col("in_trade_eng"), F.col("player"))).alias("AGAINST"),
            F.max(F.when(shown & ~F.col("in_trade_eng"), F.col("player"))).alias("TRADE"),
            F.max(F.when(F.col("win"), F.col("player"))).alias("killer"),
            F.collect_list(
                F.when(counted & F.col("last_kill_id").isNotNull(),
                       F.struct(F.col("last_victim").alias("DEAD")))
            ).alias("fallen"),
        )
        .filter(F.col("some") & ~F.col("every"))
    )
    roles = ["AGAINST", "TRADE", "DEAD"]
    trios = (
        events.withColumn("win", F.col("killer") == F.col("TRADE"))
        .select(*event, "win", "AGAINST", "TRADE", F.explode("fallen").alias("gone"))
        .select(*event, "win", "AGAINST", "TRADE", F.col("gone.DEAD").alias("DEAD"))
    )
    return unfold(trios, [*event, "win"], roles, "type", "player")


def with_event_columns(rows: DataFrame, states: DataFrame | None, *columns: str) -> DataFrame:
    """Rows with columns of their event's state: those they carry, or else by a join."""
    if all(c in rows.columns for c in columns):
        return rows
    keys = ["match_id", "event_id"]
    return rows.drop(*EVENT_COLUMNS).join(states.select(*keys, *columns), keys, "left")


def trade_triplet_matrix(
    triplets: DataFrame, players: list[str], states: DataFrame | None = None
) -> DataFrame:
    """``player_TYPE`` indicators of each triplet event beside its man-power state."""
    return presence_matrix(
        with_event_columns(triplets, states, "state"), ["match_id", "event_id", "win", "state"],
        F.concat_ws("_", "player", "type"), role_terms(players, ["AGAINST", "DEAD", "TRADE"]),
    )


def state_by_role(triplets: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """The man-power state seen from the side of each role's player."""
    sides = F.split("state", "v")
    own, other = sides.getItem(0), sides.getItem(1)
    killer_side = F.col("win") == F.col("type").isin("TRADE", "DEAD")
    seen = F.when(killer_side, F.concat(own, F.lit("v"), other)).when(
        ~killer_side, F.concat(other, F.lit("v"), own)
    )
    return with_event_columns(triplets, states, "state").select(
        "match_id", "event_id", "win", "type", "player", seen.alias("state")
    )


def trade_success(
    by_role: DataFrame,
    states: list[str],
    role: str,
    min_n: int = params.MIN_SITUATIONS,
    league_min_n: int | None = None,
) -> DataFrame:
    """Wins, losses and situations per game of each player in a role, and the league means.

    For AGAINST, l_pct is the share of second kills; for DEAD, the share of deaths traded.
    """
    table = (
        by_role.filter(F.col("state").isin(states) & (F.col("type") == role))
        .groupBy("player", "type")
        .agg(
            F.sum(F.col("win").cast("long")).alias("w"),
            F.avg(F.col("win").cast("int")).alias("w_pct"),
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("match_id").alias("games"),
        )
    )
    # The conditions on w and games change no row. They keep the columns of both uses of the
    # table the same, so that Spark runs its aggregation once and reuses the exchange.
    least = min_n if league_min_n is None else league_min_n
    counted = (F.col("n") > least) & (F.col("w") >= 0) & (F.col("games") > 0)
    rows = table.filter(F.col("n") > min_n).select(
        "player", "type", "w", (F.col("n") - F.col("w")).alias("l"), "w_pct",
        (1 - F.col("w_pct")).alias("l_pct"), "n",
        (F.col("n") / F.col("games")).alias("sit_per_game"),
        league_mean(table, "w_pct", counted).alias("league_w_pct"),
    )
    return rows.withColumn("league_l_pct", 1 - F.col("league_w_pct"))


def trade_counts(outcomes: DataFrame) -> DataFrame:
    """Events by player, role, trade attempted and trade won (both NULL without a trade)."""
    rows = unfold(
        outcomes, ["trade_att", "trade_win"], [VICTIM, KILLER, "other_player"], "type", "player_id"
    )
    return rows.groupBy("player_id", "type", "trade_att", "trade_win").agg(
        F.count(F.lit(1)).alias("n")
    )


RATES = [
    "kill_pct", "death_pct", "trade_att_kill_pct", "no_trade_att_kill_pct", "traded_kill_pct",
    "two_piece_pct", "trade_att_death_pct", "no_trade_att_death_pct", "traded_death_pct",
    "failed_trade_death_pct",
]
OLD_RATES = ["kills_traded_pct", "deaths_traded_pct", "got_two_pct", "failed_death_trade"]


def _rate_sums(counts: DataFrame) -> DataFrame:
    attempted = F.coalesce(F.col("trade_att"), F.lit(False))
    won = F.coalesce(F.col("trade_win"), F.lit(False))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    kill, death = F.col("type") == KILLER, F.col("type") == VICTIM
    return counts.groupBy("player_id").agg(
        total(kill).alias("kills"),
        total(death).alias("deaths"),
        total(kill & attempted).alias("kills_att"),
        total(kill & attempted & won).alias("kills_won"),
        total(death & attempted).alias("deaths_att"),
        total(death & attempted & won).alias("deaths_won"),
        F.sum("n").alias("n"),
    )


def player_trade_rates(counts: DataFrame, min_n: int = params.MIN_RATE_N) -> DataFrame:
    """Ten shares per player with more than ``min_n`` role rows; NULL where nothing to divide."""
    kills, deaths = F.col("kills"), F.col("deaths")
    kill = F.try_divide(kills, kills + deaths)
    kill_att = F.try_divide(F.col("kills_att"), kills)
    death_att = F.try_divide(F.col("deaths_att"), deaths)
    return _rate_sums(counts).filter(F.col("n") > min_n).select(
        "player_id",
        kill.alias("kill_pct"),
        (1 - kill).alias("death_pct"),
        kill_att.alias("trade_att_kill_pct"),
        (1 - kill_att).alias("no_trade_att_kill_pct"),
        F.try_divide(F.col("kills_won"), kills).alias("traded_kill_pct"),
        F.try_divide(F.col("kills_att") - F.col("kills_won"), kills).alias("two_piece_pct"),
        death_att.alias("trade_att_death_pct"),
        (1 - death_att).alias("no_trade_att_death_pct"),
        F.try_divide(F.col("deaths_won"), deaths).alias("traded_death_pct"),
        F.try_divide(F.col("deaths_att") - F.col("deaths_won"), deaths).alias(
            "failed_trade_death_pct"
        ),
        "n",
    )


def player_trade_rates_old(counts: DataFrame, min_n: int = params.MIN_RATE_N) -> DataFrame:
    """The older set of four rates: the last two are shares of the attempted trades.

    ``kills_traded_pct`` and ``deaths_traded_pct`` are shares with an attempted trade.
    """
    return _rate_sums(counts).filter(F.col("n") > min_n).select(
        "player_id",
        F.try_divide(F.col("kills_att"), F.col("kills")).alias("kills_traded_pct"),
        F.try_divide(F.col("deaths_att"), F.col("deaths")).alias("deaths_traded_pct"),
        F.try_divide(F.col("kills_att") - F.col("kills_won"), F.col("kills_att")).alias(
            "got_two_pct"
        ),
        F.try_divide(F.col("deaths_att") - F.col("deaths_won"), F.col("deaths_att")).alias(
            "failed_death_trade"
        ),
        "n",
    )


def player_trade_percentiles(rates: DataFrame, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """Every rate as a row, with its percent rank among the players."""
    stats = [c for c in rates.columns if c != "player_id"]
    return percent_rank_by(
        gather(rates, ["player_id"], stats), "stat",
        descending=F.col("stat").isin(list(lower_is_better)) if lower_is_better else False,
    )
