"""The model jobs: which rows and terms each one is fitted on.

Every job returns its tidy coefficient table; the ``*_rows`` functions build the rows, so
that they can be inspected, split or fitted in another way.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params
from ..operators.scan import event_keys
from ..operators.state import manpower_state, trader_role
from ..operators.xkill import duels
from ..plans.ratings import tidy_terms
from .cox import CoxFit, fit_cox
from .design import (
    add_term, collect_terms, level_term, player_terms, settled, train_test_split,
    varying_terms, with_fold,
)
from .fits import (
    cross_validate, fit_logistic, fit_ridge_linear, fit_ridge_logistic, logistic_table,
    player_table, predict,
)

EVENT = ["match_id", "event_id"]
XKILL_INPUTS = ["pkk_x", "tsla_x", "pkk_y", "tsla_y", "both"]
TRADER_ROLES = ("AGAINST", "DEAD", "KILLER")


def side_terms(alive: DataFrame) -> DataFrame:
    """The feed with its states and, per event, the ``player_SIDE`` terms of those alive."""
    term = F.concat_ws("_", "player_id", "type")
    return manpower_state(alive, F.when(F.col("alive") == 1, term))


def trade_attempted_rows(alive: DataFrame) -> DataFrame:
    """Every event: was a trade attempted, who could act in which role, the advantage.

    ``alive`` is the roster of the trade outcomes, so that the outcome is on its rows and
    one aggregate per event gives everything.
    """
    role = trader_role()
    acting = (F.col("alive") == 1) & (role != "FOR")
    rows = manpower_state(
        alive, F.when(acting, F.concat_ws("_", F.col("player_id"), role)), ("trade_att",)
    )
    tried = F.coalesce(F.col("trade_att"), F.lit(False))
    return add_term(rows.select(*EVENT, "adv", tried.alias("outcome"), "terms"), level_term("adv"))


def trade_won_rows(roles: DataFrame) -> DataFrame:
    """Every attempted trade: was the kill traded, the three players, the advantage.

    ``roles`` carries the advantage of its event.
    """
    terms = collect_terms(
        roles, [*event_keys(roles), "traded"], F.concat_ws("_", "player_id", "p"), F.lit(True)
    ).withColumnRenamed("traded", "outcome")
    return add_term(terms.filter(F.col("adv").isNotNull()), level_term("adv"))


def duel_rows(situations: DataFrame) -> DataFrame:
    """Every side of an event with a trade: won or not, expectation, player, advantage."""
    rows = situations.filter(F.col("adv").isNotNull() & (F.col("trade_sit") != "NONE"))
    return rows.select(
        *EVENT, "player", F.col("win").alias("outcome"), "pred_win",
        F.array(F.concat(F.col("player"), F.lit("_ENG")), level_term("adv")).alias("terms"),
    )


def _odds_ratios(
    rows: DataFrame, players: list[str], adv_baseline: int, seed: int,
    numeric: list[str] | None = None, keys: list[str] = EVENT,
) -> DataFrame:
    """Fit on the training share of the rows: advantage levels and the player terms."""
    train, _ = train_test_split(rows, keys, seed)
    with settled(train) as train:
        terms = varying_terms(train, players, "adv", str(adv_baseline))
        return logistic_table(train, F.col("outcome"), terms, numeric)


def trade_attempted_model(
    alive: DataFrame, roster: DataFrame, roles=TRADER_ROLES, min_games: int = params.MIN_GAMES,
    baseline_player: str | None = None, adv_baseline: int = -2, seed: int = 7,
) -> DataFrame:
    """Odds ratios of an attempted trade by advantage and player role."""
    players = player_terms(roster, list(roles), min_games, baseline_player)
    return _odds_ratios(trade_attempted_rows(alive), players, adv_baseline, seed)


# The model of stopped trades has the same outcome, rows and terms.
stop_trade_model = trade_attempted_model


def trade_won_model(
    roles_long: DataFrame, roster: DataFrame, roles=("P1", "P2", "P3"),
    min_games: int = params.MIN_GAMES, baseline_player: str | None = None,
    adv_baseline: int = -2, seed: int = 7,
) -> DataFrame:
    """Odds ratios of a won trade by advantage and player role, split into player and type."""
    players = player_terms(roster, list(roles), min_games, baseline_player)
    return tidy_terms(_odds_ratios(trade_won_rows(roles_long), players, adv_baseline, seed))


def duel_model(
    situations: DataFrame, roster: DataFrame, min_games: int = params.MIN_GAMES,
    baseline_player: str | None = None, adv_baseline: int = -3, seed: int = 7,
) -> DataFrame:
    """Odds ratios of a won duel by expectation, advantage and player."""
    players = player_terms(roster, ["ENG"], min_games, baseline_player)
    return _odds_ratios(
        duel_rows(situations), players, adv_baseline, seed, ["pred_win"], [*EVENT, "player"]
    )


def xkill_inputs(pairs: DataFrame) -> DataFrame:
    """Numeric columns of the duel model, with the interaction of both streaks."""
    return pairs.withColumns({
        "both": (F.col("pkk_x") & F.col("pkk_y")).cast("double"),
        "pkk_x": F.col("pkk_x").cast("double"),
        "pkk_y": F.col("pkk_y").cast("double"),
    })


def xkill_fit(pairs: DataFrame, seed: int = 7):
    """The expected-kill model: no intercept, both sides' streak and gap, and an interaction."""
    complete = xkill_inputs(pairs).dropna("any", subset=[*XKILL_INPUTS, "win_x"])
    with settled(complete.select(*EVENT, *XKILL_INPUTS, "win_x")) as kept:
        train, _ = train_test_split(kept, EVENT, seed)
        return fit_logistic(
            train, F.col("win_x"), [], XKILL_INPUTS, intercept=False, exponentiate=False
        )


def xkill_model(pairs: DataFrame, seed: int = 7) -> DataFrame:
    return xkill_fit(pairs, seed)[2]


def xkill_predictions(pairs: DataFrame, fit, seed: int = 7) -> DataFrame:
    """Probability that side x wins, on the rows held back from the fit."""
    _, test = train_test_split(xkill_inputs(pairs), EVENT, seed)
    return predict(fit[0], test, fit[1]).select(
        *EVENT, F.col("prediction").alias("pred_win"), F.col("win_x").alias("win")
    )


def xkill_normalised(steps: DataFrame, fit) -> DataFrame:
    """Each side's model probability against its opponent, as a share of the event's total.

    Both sides of an event sit on one row, so no window is needed for the total.
    """
    keys = EVENT

    def scored(rows: DataFrame, x: str, y: str, out: str) -> DataFrame:
        inputs = xkill_inputs(rows.withColumns({
            "pkk_x": F.col(f"{x}.pkk"), "tsla_x": F.col(f"{x}.tsla"),
            "pkk_y": F.col(f"{y}.pkk"), "tsla_y": F.col(f"{y}.tsla"),
        }))
        return predict(fit[0], inputs, fit[1]).withColumnRenamed("prediction", out).drop(
            *XKILL_INPUTS
        )

    both = scored(scored(duels(steps), "v", "k", "p_v"), "k", "v", "p_k")
    total = F.col("p_v") + F.col("p_k")
    sides = F.explode(F.array(
        F.struct(F.lit("id").alias("type"), F.col("v.player").alias("player"),
                 F.try_divide(F.col("p_v"), total).alias("xkill"), F.lit(0).alias("win")),
        F.struct(F.lit("attacker_id").alias("type"), F.col("k.player").alias("player"),
                 F.try_divide(F.col("p_k"), total).alias("xkill"), F.lit(1).alias("win")),
    ))
    return both.select(*keys, sides.alias("s")).select(*keys, "s.*")


def win_rows(plus_minus: DataFrame) -> DataFrame:
    """Every team of a match with a result: victory and kill difference."""
    rows = plus_minus.filter(F.col("is_victor").isNotNull())
    return rows.select("is_victor", F.col("pm").cast("double").alias("adv"))


def win_model(plus_minus: DataFrame) -> DataFrame:
    """Log odds of a match win by kill difference."""
    with settled(win_rows(plus_minus)) as kept:
        return logistic_table(kept, F.col("is_victor"), [], ["adv"], exponentiate=False)


def triplet_rows(triplets: DataFrame) -> DataFrame:
    """Every trade: did the avenger win, the three players' roles, the state of its event."""
    rows = collect_terms(
        triplets.filter(F.col("win").isNotNull()), [*event_keys(triplets), "win"],
        F.concat_ws("_", "player", "type"), F.col("player").isNotNull(),
    )
    return add_term(rows, level_term("state")).withColumnRenamed("win", "outcome")


def triplet_model(
    triplets: DataFrame, roster: DataFrame, min_games: int = 0, penalty: float = 1e-9,
    seed: int = 7,
) -> DataFrame:
    """Ridge logistic: does the avenger win, by state and by the three players' roles.

    ``triplets`` carries the state of its event.
    """
    players = player_terms(roster, ["AGAINST", "DEAD", "TRADE"], min_games, "")
    train, _ = train_test_split(triplet_rows(triplets), EVENT, seed)
    with settled(train) as train:
        terms = varying_terms(train, players, "state")
        return fit_ridge_logistic(train, F.col("outcome"), terms, penalty=penalty)[2]


def talent_rows(xkill: DataFrame) -> DataFrame:
    """Every side of every event: won or not, expected probability, and the player."""
    return xkill.filter(F.col("xkill").isNotNull()).select(
        *EVENT, "type", F.col("win").alias("outcome"), F.col("xkill").alias("kill_prob"),
        F.array("player").alias("terms"),
    )


def talent_terms(rows: DataFrame, roster: DataFrame, min_games: int) -> list[str]:
    names = [t.rsplit("_", 1)[0] for t in player_terms(roster, ["x"], min_games, "")]
    return varying_terms(rows, names)


def talent_model(
    xkill: DataFrame, roster: DataFrame, min_games: int = params.MIN_GAMES, penalty: float = 1e-9,
) -> DataFrame:
    """Ridge logistic of winning beyond the expected probability, as odds and probability."""
    with settled(talent_rows(xkill)) as rows:
        terms = talent_terms(rows, roster, min_games)
        table = fit_ridge_logistic(rows, F.col("outcome"), terms, ["kill_prob"], penalty)[2]
    odds = F.exp("estimate")
    return table.select(
        F.col("term").alias("name"), "estimate", odds.alias("odds"),
        (odds / (1 + odds)).alias("prob"),
    )


def talent_log_loss(
    xkill: DataFrame, roster: DataFrame, min_games: int = params.MIN_GAMES, folds: int = 10,
    penalty: float = 0.0, seed: int = 7,
) -> DataFrame:
    """Held-out log loss of the talent model, over folds of the training rows."""
    train, _ = train_test_split(talent_rows(xkill), [*EVENT, "type"], seed)
    with settled(with_fold(train, [*EVENT, "type"], folds)) as rows:
        terms = talent_terms(rows, roster, min_games)
        return cross_validate(
            rows, F.col("outcome"), terms, ["kill_prob"], [penalty], folds, "logistic"
        )


def shot_quality_rows(xkill: DataFrame, shifts: DataFrame) -> DataFrame:
    """The first event of each shift: the victim's expected share, who was alive where.

    ``shifts`` comes from ``side_terms``.
    """
    victims = xkill.filter((F.col("type") == "id") & F.col("xkill").isNotNull())
    rows = victims.select(*EVENT, "xkill").join(shifts.select(*EVENT, "adv", "terms"), EVENT)
    return add_term(rows, level_term("adv"))


def shot_quality_model(
    xkill: DataFrame, shifts: DataFrame, roster: DataFrame, min_games: int = params.MIN_GAMES,
    penalty: float = 1e-9, baseline_player: str | None = None,
) -> DataFrame:
    """Ridge linear fit of expected kills on advantage and players, as a player table."""
    players = player_terms(roster, ["AGAINST", "FOR"], min_games, baseline_player)
    with settled(shot_quality_rows(xkill, shifts)) as rows:
        terms = varying_terms(rows, players, "adv")
        table = fit_ridge_linear(rows, F.col("xkill"), terms, penalty=penalty)[2]
    return player_table(table, ["AGAINST", "FOR"], "FOR", "AGAINST")


def shot_quality_grid(
    xkill: DataFrame, shifts: DataFrame, roster: DataFrame, min_games: int = params.MIN_GAMES,
    penalties: list[float] | None = None, folds: int = 10, baseline_player: str | None = None,
) -> DataFrame:
    """Held-out error of the shot quality fit over a grid of penalties."""
    players = player_terms(roster, ["AGAINST", "FOR"], min_games, baseline_player)
    with settled(with_fold(shot_quality_rows(xkill, shifts), EVENT, folds)) as rows:
        terms = varying_terms(rows, players, "adv")
        return cross_validate(rows, F.col("xkill"), terms, None, penalties, folds, "linear")


def pace_rows(pace: DataFrame) -> DataFrame:
    """Every event after a match's first: time since the one before, state, who was alive."""
    timed = pace.filter(F.col("duration").isNotNull())
    return add_term(timed.select(*EVENT, "state", "model_ms", "terms"), level_term("state"))


def pace_fit(
    pace: DataFrame, roster: DataFrame, min_games: int = params.MIN_GAMES,
    folds: int = 4, levels: int = 10, rule: str = "1se", seed: int = 7,
) -> CoxFit:
    """Ridge Cox fit of the time between events on its state and on who was alive where.

    ``pace`` comes from ``side_terms``.
    """
    players = player_terms(roster, ["AGAINST", "FOR"], min_games, "")
    train, _ = train_test_split(pace_rows(pace), EVENT, seed)
    with settled(with_fold(train, EVENT, folds)) as kept:
        terms = varying_terms(kept, players, "state")
        return fit_cox(kept, "model_ms", terms, folds, levels=levels, rule=rule)


def pace_table(fit: CoxFit) -> DataFrame:
    """Hazard ratios as a player table: base, against and for, 0 where absent."""
    ratios = fit.table.select("term", F.col("hazard_ratio").alias("estimate"))
    return player_table(ratios, ["AGAINST", "FOR"], "FOR", "AGAINST")


def as_pipeline(model, columns: tuple[list[str], list[str]]) -> PipelineModel:
    """A fitted model with its feature stages, to save with ``write().save`` and load again."""
    terms, numeric = columns
    stages, inputs = [], list(numeric)
    if terms:
        stages.append(
            CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="held")
        )
        inputs.append("held")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return PipelineModel([*stages, model])
