"""From an event table to engagement rows: who met whom, and in which part of a life.

The feed is shuffled once, by ``event_sequence``, on the match, or on match and block where the
session asks for blocks. The later windows on (match, player) and the aggregates on (match,
event) are satisfied by that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import clip_gap
from .scan import by_match, event_keys, number_events, scan

VICTIM, KILLER = "id", "attacker_id"


def mode_deaths(
    events: DataFrame,
    match_info: DataFrame,
    event_type: str = params.EVENT_TYPE,
    mode: str = params.MODE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Events of one type in matches of one mode, as match, time, victim and killer.

    ``keep`` names further event columns, such as a tie-breaker, to carry along. The events
    are dealt by match here already, which serves the join and all later steps.
    """
    matches = match_info.filter(F.col("mode") == mode).select("match_id")
    time = F.col("time_ms").cast("long").alias("time_ms")
    return (
        by_match(events.filter(F.col("type") == event_type))
        .join(matches, "match_id")
        .select("match_id", time, VICTIM, KILLER, *keep)
    )


def event_sequence(deaths: DataFrame, tie_breaker: str | None = None) -> DataFrame:
    """Number the events of each match by time, then tie-breaker (or victim and killer)."""
    ties = [tie_breaker] if tie_breaker else [VICTIM, KILLER]
    numbered = number_events(deaths, ["time_ms", *ties])
    return numbered.drop(tie_breaker) if tie_breaker else numbered


def engagement_long(sequence: DataFrame) -> DataFrame:
    """Two rows per event, the victim's first; both ids of the event stay on the row.

    A state and advantage of the event, if the feed has them, stay as well.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit(VICTIM).alias("type"), F.lit(0).alias("role_ord"),
                     F.col(VICTIM).alias("player"), F.col(KILLER).alias("other_player")),
            F.struct(F.lit(KILLER).alias("type"), F.lit(1).alias("role_ord"),
                     F.col(KILLER).alias("player"), F.col(VICTIM).alias("other_player")),
        )
    )
    kept = event_keys(sequence, "time_ms")
    return sequence.select(*kept, F.col(VICTIM).alias("victim"), sides.alias("side")).select(
        *kept, "victim", "side.*"
    )


def life_streak(
    long: DataFrame, gap_cap_ms: int = params.GAP_CAP_MS, pdk_ms: int = params.PDK_MS
) -> DataFrame:
    """Time since last action, life number, kills earlier in the life, and their flags.

    A life starts at a player's first row and after each row in which they were the
    victim. Lives are therefore counted by earlier falls, and the streak is the number of
    rows since the latest of them, so no window on the life itself is needed.
    """
    fell = F.col("type") == VICTIM
    rows = scan(
        long, ["match_id", "player"], ["event_id", "role_ord"], number="player_row",
        previous={"prev_time": "time_ms", "prev_event": "event_id", "prev_victim": "victim"},
        total={"falls": fell.cast("long")}, latest={"last_fall": fell},
    )
    rows = rows.withColumn("life", F.col("falls") + F.when(fell, 0).otherwise(1))
    streak = F.col("player_row") - 1 - F.coalesce(F.col("last_fall"), F.lit(0))
    gap = F.col("time_ms") - F.coalesce(F.col("prev_time"), F.lit(0))
    return (
        rows.withColumns({"tsla": clip_gap(gap, gap_cap_ms), "streak": streak.cast("long")})
        .withColumns({
            "pdk": (F.col("tsla") < pdk_ms) & (F.col("streak") == 0),
            "pkk": F.col("streak") > 0,
            "first_eng": F.col("streak") == 0,
        })
        .drop("player_row", "falls", "last_fall")
    )


def trade_flags(lives: DataFrame, trade_ms: int = params.TRADE_MS) -> DataFrame:
    """The player's previous kill of this life, and whether this event may answer it."""
    in_life = F.col("streak") >= 1
    gap = F.col("time_ms") - F.when(in_life, F.col("prev_time")).otherwise(F.lit(0))
    return lives.withColumns({
        "last_kill_id": F.when(in_life, F.col("prev_event")),
        "last_kill_s": gap,
        "last_victim": F.when(in_life, F.col("prev_victim")),
        "in_trade_eng": in_life & (gap < trade_ms) & ~F.col("pdk"),
        "win": F.col("type") == KILLER,
        "traded": F.col("type") == VICTIM,
    }).drop("prev_time", "prev_event", "prev_victim")


def opponent(long: DataFrame) -> DataFrame:
    """Each engagement row with the other player of its event."""
    return long.select(
        "match_id", "event_id", "type", "player", "other_player"
    )


def engagements(
    sequence: DataFrame,
    gap_cap_ms: int = params.GAP_CAP_MS,
    pdk_ms: int = params.PDK_MS,
    trade_ms: int = params.TRADE_MS,
) -> DataFrame:
    """All engagement features of a numbered feed."""
    return trade_flags(life_streak(engagement_long(sequence), gap_cap_ms, pdk_ms), trade_ms)


def first_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of the first ``n`` keys in sort order.

    The keys are taken by a distributed top-n over the distinct keys, not by ranking all
    rows, and the semi join drops the other rows before anything is shuffled.
    """
    keys = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(keys, key, "left_semi")
