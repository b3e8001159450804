"""Expected kills: how likely each player of an event was to win the duel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import odds_to_probability
from .feed import KILLER, VICTIM
from .reshape import presence_matrix
from .scan import by_event, event_keys
from .trades import with_event_columns

FEATURES = ["player", "pkk", "tsla", "pdk", "in_trade_eng"]


def duels(steps: DataFrame) -> DataFrame:
    """One row per event with the features of the victim (``v``) and the killer (``k``).

    A conditional aggregate on the event replaces the join of the rows with themselves.
    """
    def side(role: str, name: str):
        return F.first(
            F.when(F.col("type") == role, F.struct(*FEATURES)), ignorenulls=True
        ).alias(name)

    return by_event(steps, *event_keys(steps)).agg(
        side(VICTIM, "v"), side(KILLER, "k")
    ).drop("in_block")


def key_hash(*parts: str | Column) -> Column:
    """A hash of row keys that does not depend on the partitioning."""
    columns = [F.col(part) if isinstance(part, str) else part for part in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def one_per_group(rows: DataFrame, keys: list[str], tie: str, seed: int = 0) -> DataFrame:
    """One pseudo-random row per group: the one with the smallest hash of keys, tie and seed.

    The minimum is taken before the shuffle too, so a group of any size sends one row per
    task.
    """
    picked = rows.withColumn("h", key_hash(*keys, tie, F.lit(seed)))
    rest = [c for c in rows.columns if c not in keys]
    return (
        picked.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), "h").alias("r"))
        .select(*keys, "r.*")
    )


def xkill_pairs(steps: DataFrame, seed: int = 0) -> DataFrame:
    """Duels in which neither side just respawned, with one hash-chosen side as ``y``.

    Side ``y`` is the one whose hash of match, event, role and seed is smaller.
    """
    both = duels(steps).filter(~F.col("v.pdk") & ~F.col("k.pdk"))
    victim_hash = key_hash("match_id", "event_id", F.lit(VICTIM), F.lit(seed))
    killer_hash = key_hash("match_id", "event_id", F.lit(KILLER), F.lit(seed))
    y_is_victim = victim_hash < killer_hash

    def pick(field: str, suffix: str):
        first, second = ("k", "v") if suffix == "x" else ("v", "k")
        return F.when(y_is_victim, F.col(f"{first}.{field}")).otherwise(F.col(f"{second}.{field}"))

    return both.select(
        *event_keys(steps),
        *[
            pick(field, s).alias(f"{name}_{s}")
            for s in ("x", "y")
            for field, name in (
                ("player", "player"), ("pkk", "pkk"), ("tsla", "tsla"),
                ("in_trade_eng", "in_trade"),
            )
        ],
        y_is_victim.alias("win_x"),
        (~y_is_victim).alias("win_y"),
    )


def closed_form_probability(
    streak: float = params.XKILL_STREAK,
    gap: float = params.XKILL_GAP,
    both: float = params.XKILL_BOTH,
) -> Column:
    """Probability that side x wins, from the streak and gap columns of both sides."""
    def one(flag):
        return flag.cast("int")

    log_odds = (
        streak * one(F.col("pkk_x")) + gap * F.col("tsla_x")
        - streak * one(F.col("pkk_y")) - gap * F.col("tsla_y")
        + both * one(F.col("pkk_x") & F.col("pkk_y"))
    )
    return odds_to_probability(F.exp(log_odds))


def xkill_closed_form(
    pairs: DataFrame,
    streak: float = params.XKILL_STREAK,
    gap: float = params.XKILL_GAP,
    both: float = params.XKILL_BOTH,
) -> DataFrame:
    """The published duel model on each pair, as one row per side: p for x, 1 - p for y.

    Each row also says whether the other side is in a trade.
    """
    keys = event_keys(pairs)

    def side(own: str, other: str, p: Column) -> Column:
        return F.struct(
            F.col(f"player_{own}").alias("player"), p.alias("pred_win"),
            F.col(f"win_{own}").alias("win"), F.col(f"in_trade_{own}").alias("in_trade"),
            F.col(f"in_trade_{other}").alias("other_in_trade"),
        )

    sides = F.explode(F.array(side("x", "y", F.col("p")), side("y", "x", 1 - F.col("p"))))
    scored = pairs.withColumn("p", closed_form_probability(streak, gap, both))
    return scored.select(*keys, sides.alias("s")).select(*keys, "s.*")


def trade_situation(scores: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Each scored side with its trade situation, and the advantage from its own view.

    BOTH players are in a trade, only this one (SOLO), only the OTHER, or NONE.
    """
    scores = with_event_columns(scores, states, "adv")
    situation = (
        F.when(F.col("in_trade") & F.col("other_in_trade"), "BOTH")
        .when(F.col("in_trade"), "SOLO")
        .when(F.col("other_in_trade"), "OTHER")
        .otherwise("NONE")
    )
    kept = [k for k in event_keys(scores) if k != "adv"]
    return scores.select(
        *kept, "player", "pred_win", "win", "in_trade", situation.alias("trade_sit"),
        F.when(F.col("win"), F.col("adv")).otherwise(-F.col("adv")).alias("adv"),
    )


def engagement_matrix(situations: DataFrame, players: list[str]) -> DataFrame:
    """A ``player_ENG`` indicator per listed player beside outcome, expectation, advantage."""
    ids = ["match_id", "event_id", "pred_win", "win", "in_trade", "trade_sit", "adv"]
    return presence_matrix(
        situations, ids, F.concat(F.col("player"), F.lit("_ENG")),
        [f"{p}_ENG" for p in sorted(players)],
    )
