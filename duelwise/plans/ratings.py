"""Ratings put together from coefficient tables and activity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params
from ..functions import odds_to_probability, per_minute, recode, term_parts
from ..operators.feed import KILLER, VICTIM
from ..operators.ranking import league_mean, percent_rank_by
from ..operators.reshape import gather, spread, unfold
from ..operators.state import with_roster

PROBABILITIES = [
    "p_kill", "p_death", "p_trade_att_kill", "p_no_trade_att_kill", "p_traded_kill",
    "p_two_piece", "p_trade_att_death", "p_no_trade_att_death", "p_fail_trade", "p_traded_death",
]

# Labels of the five shown statistics, in display order, with the name of
# the rating and of the observed rate behind each.
IMPACT_LABELS = (
    ("Gunfight Win%", "p_kill", "kill_pct"),
    ("Kill - No Trade Attempt%", "p_no_trade_att_kill", "no_trade_att_kill_pct"),
    ("Get Two-Piece", "p_two_piece", "two_piece_pct"),
    ("Death - Trade Attempt%", "p_trade_att_death", "trade_att_death_pct"),
    ("Death Traded Success%", "p_traded_death", "traded_death_pct"),
)


def tidy_terms(terms: DataFrame) -> DataFrame:
    """Coefficient rows with ``term`` split into player and type."""
    player, role = term_parts(F.col("term"))
    rest = [F.col(f"`{c}`") for c in terms.columns if c != "term"]
    return terms.select(player.alias("player"), role.alias("type"), *rest)


def _scaled(odds: str, *factors: float) -> Column:
    shift = F.log(F.col(odds))
    for factor in factors:
        shift = shift + F.log(F.lit(factor))
    return F.exp(shift)


def player_betas(skill: DataFrame, trade_terms: DataFrame, won_roles: DataFrame) -> DataFrame:
    """Five odds per player: duel, trade tried on kill and on death, trade won as P1 and P2.

    Coefficients of the model parts that are not the player's enter as fixed averages.
    """
    offset = params.SKILL_INTERCEPT + params.SKILL_AT * params.SKILL_SLOPE
    duel = skill.select(
        F.col("name").alias("player_id"), F.exp(F.col("estimate") + offset).alias("beta_1")
    )
    tried = spread(tidy_terms(trade_terms), ["player"], "type", "estimate", ["KILLER", "DEAD"])
    tried = tried.select(
        F.col("player").alias("player_id"),
        _scaled("KILLER", params.TRADE_BASE, params.TRADE_ADV, params.TRADE_OTHER_KILLER).alias(
            "beta_2"
        ),
        _scaled("DEAD", params.TRADE_BASE, params.TRADE_ADV, params.TRADE_OTHER_DEAD).alias(
            "beta_3"
        ),
    )
    won = spread(won_roles, ["player"], "type", "estimate", ["P1", "P2"])
    won = won.select(
        F.col("player").alias("player_id"),
        _scaled("P1", params.WON_BASE, params.WON_OTHER_P1, params.WON_ADV).alias("beta_4"),
        _scaled("P2", params.WON_BASE, params.WON_OTHER_P2, params.WON_ADV).alias("beta_5"),
    )
    return duel.join(tried, "player_id", "left").join(won, "player_id", "left")


def player_probabilities(betas: DataFrame, unconditional: bool = False) -> DataFrame:
    """Ten probabilities per player. ``unconditional`` weighs the outcomes of an attempted
    trade by the probability of the kill or death before it; otherwise it is taken as given.
    """
    kill = odds_to_probability(F.col("beta_1"))
    after_kill = kill if unconditional else F.lit(1.0)
    after_death = 1 - kill if unconditional else F.lit(1.0)
    tried_kill = odds_to_probability(F.col("beta_2"))
    tried_death = odds_to_probability(F.col("beta_3"))
    lost = odds_to_probability(F.col("beta_4"))
    failed = odds_to_probability(F.col("beta_5"))
    values = [
        kill, 1 - kill, tried_kill, 1 - tried_kill,
        lost * tried_kill * after_kill, (1 - lost) * tried_kill * after_kill,
        tried_death, 1 - tried_death,
        failed * tried_death * after_death, (1 - failed) * tried_death * after_death,
    ]
    return betas.withColumns(dict(zip(PROBABILITIES, values)))


def expected_engagement_value(probabilities: DataFrame) -> DataFrame:
    """Expected kills that one engagement brings a player's team beyond itself."""
    value = (
        F.col("p_trade_att_kill") + F.col("p_two_piece") * 2
        - F.col("p_trade_att_death") - F.col("p_fail_trade") * 2
    )
    return probabilities.select("player_id", value.alias("exp_eng"))


def engagement_counts(long: DataFrame) -> DataFrame:
    return long.groupBy(F.col("player").alias("player_id")).agg(F.count(F.lit(1)).alias("n"))


def time_played(boxscores: DataFrame, match_info: DataFrame, mode: str | None) -> DataFrame:
    matches = match_info if mode is None else match_info.filter(F.col("mode") == mode)
    return (
        boxscores.join(matches.select("match_id", "duration_ms"), "match_id")
        .groupBy(F.col("name").alias("player_id"))
        .agg((F.sum("duration_ms") / 1000).alias("time_s"))
    )


def expected_kills_added(values: DataFrame, counts: DataFrame, played: DataFrame) -> DataFrame:
    """Engagement value times engagements, per minute played, beside the league mean."""
    added = (
        values.join(counts, "player_id", "left")
        .withColumn("added", F.col("exp_eng") * F.col("n"))
        .join(played, "player_id", "left")
        .withColumn("kapm", per_minute(F.col("added"), F.col("time_s")))
    )
    return added.withColumn("league_kapm", league_mean(added, "kapm"))


def value_per_10min(probabilities: DataFrame, box_long: DataFrame) -> DataFrame:
    """Value of a player's engagements in ten minutes at their pace."""
    pace = box_long.filter(F.col("stat") == "epm").select(
        F.col("name").alias("player_id"), F.col("value").alias("epm")
    )
    value = (
        -F.col("p_death") * F.col("p_no_trade_att_death")
        - F.col("p_death") * F.col("p_fail_trade")
        + F.col("p_kill") * F.col("p_trade_att_kill")
        + F.col("p_kill") * F.col("p_two_piece")
    ) * F.col("epm") * 10
    return probabilities.join(pace, "player_id", "left").select(
        "player_id",
        F.col("p_kill").alias("kill"),
        F.col("p_no_trade_att_kill").alias("no_trade_attempted_kill"),
        F.col("p_two_piece").alias("two_piece"),
        F.col("p_trade_att_death").alias("trade_attempted_death"),
        F.col("p_traded_death").alias("traded_death"),
        value.alias("eng_value_10"),
    )


def players_only(
    table: DataFrame, others: tuple[str, ...] = ("(Intercept)", "kill_prob")
) -> DataFrame:
    """Drop the rows of model terms that are not players."""
    return table.filter(~F.col("player_id").isin(*others))


def coef_percentiles(table: DataFrame) -> DataFrame:
    """Every coefficient and probability as a row with percent rank and league average."""
    stats = [c for c in table.columns if c != "player_id"]
    ranked = percent_rank_by(gather(table, ["player_id"], stats, "name"), "name")
    averages = ranked.groupBy("name").agg(F.avg("value").alias("avg"))
    return ranked.join(averages, "name", "left")


def impact_vs_actual(coefs_long: DataFrame, rates_long: DataFrame) -> DataFrame:
    """Five ratings and the five observed rates under shared labels, with display order."""
    order = {label: place for place, (label, _, _) in enumerate(IMPACT_LABELS, 1)}

    def shown(rows: DataFrame, stat: str, names: dict[str, str], actual: bool) -> DataFrame:
        return rows.filter(F.col(stat).isin(list(names))).select(
            "player_id", recode(F.col(stat), names).alias("name"), "value", "percentile",
            *([F.col("avg")] if "avg" in rows.columns else []),
            F.lit(actual).alias("actual"),
        )

    impact = shown(coefs_long, "name", {p: label for label, p, _ in IMPACT_LABELS}, False)
    actual = shown(rates_long, "stat", {r: label for label, _, r in IMPACT_LABELS}, True)
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return impact.unionByName(actual, allowMissingColumns=True).withColumn(
        "ord", F.element_at(place, F.col("name"))
    )


def _by_side(side: str, value: Column) -> Column:
    return F.sum(F.when(F.col("name") == side, value).otherwise(0))


def roster_games(roster: DataFrame) -> DataFrame:
    return roster.groupBy("player_id").agg(F.count(F.lit(1)).alias("games"))


def side_values(table: DataFrame) -> DataFrame:
    """A player table of a model job as rows (player_id, name, value), name being the side.

    A player table has 0 where a player has no coefficient; such sides have no row.
    """
    sides = table.select(F.col("name").alias("player_id"), "FOR", "AGAINST")
    return unfold(sides, ["player_id"], ["FOR", "AGAINST"], "name", "value").filter("value <> 0")


def pace_added(coefs: DataFrame, alive_time: DataFrame, games: DataFrame) -> DataFrame:
    """Engagements that a player's pace adds: actual minus those at base pace, per game.

    ``coefs`` has player_id, name (FOR or AGAINST) and value.
    """
    seconds = F.col("toi") / 1000
    base = F.try_divide(F.try_divide(F.col("engs"), seconds), F.col("value"))
    sides = coefs.join(
        alive_time.withColumnRenamed("type", "name"), ["player_id", "name"]
    ).withColumn("potential", base * seconds)
    actual = _by_side("FOR", F.col("engs")) - _by_side("AGAINST", F.col("engs"))
    potential = _by_side("FOR", F.col("potential")) - _by_side("AGAINST", F.col("potential"))
    return (
        sides.groupBy("player_id")
        .agg((actual - potential).alias("pm_added_pace"))
        .join(games, "player_id", "left")
        .select("player_id", "pm_added_pace",
                F.try_divide(F.col("pm_added_pace"), F.col("games")).alias("kapr_pace"))
    )


def side_counts(event_roster: DataFrame) -> DataFrame:
    """Events and matches per player and side."""
    return event_roster.groupBy("player_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("match_id").alias("games")
    )


def quality_added(coefs: DataFrame, counts: DataFrame) -> DataFrame:
    """Kills that a player's presence adds: coefficient times events, against counted off."""
    sides = coefs.join(counts.withColumnRenamed("type", "name"), ["player_id", "name"])
    signed = F.when(F.col("name") == "AGAINST", -F.col("value")).otherwise(F.col("value"))
    return (
        sides.groupBy("player_id")
        .agg(
            F.sum(signed * F.col("n") * 2).alias("pm_added_total"),
            F.max_by("games", "name").alias("games"),
        )
        .select("player_id", "pm_added_total",
                F.try_divide(F.col("pm_added_total"), F.col("games")).alias("kapr_quality"))
    )


def season_engagements(sequence: DataFrame, roster: DataFrame) -> DataFrame:
    """Own engagements and matches of each player that is on the roster of the match."""
    seat = F.explode("roster").alias("seat")
    return (
        with_roster(sequence, roster)
        .select("match_id", VICTIM, KILLER, seat)
        .filter((F.col("seat.player_id") == F.col(VICTIM))
                | (F.col("seat.player_id") == F.col(KILLER)))
        .groupBy(F.col("seat.player_id").alias("player_id"))
        .agg(F.count(F.lit(1)).alias("eng"), F.countDistinct("match_id").alias("games"))
    )


def skill_added(
    skill: DataFrame, engagements: DataFrame, base_win: float = params.BASE_WIN
) -> DataFrame:
    """Kills that winning more duels than the base share adds, per game."""
    added = (F.col("eng") * F.col("prob") - F.col("eng") * base_win) * 2
    return (
        skill.withColumnRenamed("name", "player_id")
        .join(engagements, "player_id")
        .select(
            "player_id",
            added.alias("pm_added_skill"),
            F.try_divide(added, F.col("games")).alias("kapr_skill"),
        )
    )


def player_war(
    pace: DataFrame, quality: DataFrame, skill: DataFrame, games: DataFrame,
    wins_per_kill: float = params.WINS_PER_KILL,
) -> DataFrame:
    """The three parts together: per game, in total, and as wins; best first."""
    per_game = F.try_divide(F.col("pm_total"), F.col("games"))
    return (
        pace.join(quality, "player_id", "left")
        .join(skill, "player_id", "left")
        .join(games, "player_id", "left")
        .withColumns({
            "kapr": F.col("kapr_pace") + F.col("kapr_quality") + F.col("kapr_skill"),
            "pm_total": F.col("pm_added_pace") + F.col("pm_added_total") + F.col("pm_added_skill"),
        })
        .withColumn("pm_g", per_game)
        .select("player_id", "kapr", "pm_g", "pm_total",
                (F.col("pm_g") * wins_per_kill).alias("wapr"))
        .orderBy(F.col("pm_g").desc(), "player_id")
    )
