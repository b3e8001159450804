"""One Spark query per operator, on the feed derived from the test data.

Doubles are rounded so that two engines give the same digits. Thresholds are low enough
for small data; none of them cuts the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelwise.functions import odds_ratio_delta
from duelwise.models import design, fits, jobs
from duelwise.operators import feed, state, trades, xkill
from duelwise.operators.settle import settle
from duelwise.plans import ratings, tables
from duelwise.sources.testdata import PLAYERS, Feed

MIN_N, MIN_GAMES, MIN_SITUATIONS, BOX_MIN_TIME, SEASON_GAMES = 200, 10, 20, 6000, 2
EVENT = ["match_id", "event_id"]

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in doubles})


def on(build: Callable[[Feed], DataFrame]) -> Query:
    return lambda spark, path: rounded(build(Feed(spark, path)))


def _rates(f: Feed) -> DataFrame:
    return trades.player_trade_rates(trades.trade_counts(f.outcomes), MIN_N)


def _rates_long(f: Feed) -> DataFrame:
    return trades.player_trade_percentiles(_rates(f))


def _roles(f: Feed, with_state: bool = False) -> DataFrame:
    outcomes = f.state_outcomes if with_state else f.outcomes
    return trades.trade_roles_long(trades.trades_only(outcomes))


def _steps15(f: Feed) -> DataFrame:
    return feed.engagements(f.sequence, trade_ms=15000)


def _state_triplets(f: Feed) -> DataFrame:
    return trades.trade_triplets(feed.engagements(f.states, trade_ms=15000))


def _by_role(f: Feed) -> DataFrame:
    return trades.state_by_role(_state_triplets(f))


def _situations(f: Feed) -> DataFrame:
    return xkill.trade_situation(f.state_scores)


def _team_rows(f: Feed) -> DataFrame:
    return state.team_advantage(f.states, f.roster)


def _shifts(f: Feed) -> DataFrame:
    return state.state_shifts(jobs.side_terms(f.alive))


def _times_wide(f: Feed) -> DataFrame:
    return state.time_at_advantage_wide(
        state.time_at_advantage(_team_rows(f)), state.advantage_levels(f.roster))


def _plus_minus(f: Feed, mode: str | None = None) -> DataFrame:
    return state.team_plus_minus(f.boxscores, f.match_scores, f.match_info, mode)


def _betas(f: Feed) -> DataFrame:
    return ratings.player_betas(f.skill, f.trade_terms, f.won_roles)


def _probabilities(f: Feed) -> DataFrame:
    return ratings.player_probabilities(_betas(f))


def _box(f: Feed) -> DataFrame:
    return tables.box_stats(f.boxscores, f.match_info, None, BOX_MIN_TIME)


def _coefs_long(f: Feed) -> DataFrame:
    return ratings.coef_percentiles(ratings.players_only(_probabilities(f)))


def _seasons(f: Feed) -> DataFrame:
    return tables.season_stats(f.boxscores, f.match_info)


def _pace(f: Feed) -> DataFrame:
    return ratings.pace_added(
        f.pace_coefs, state.player_time_alive(f.alive), ratings.roster_games(f.roster)
    )


def _quality(f: Feed) -> DataFrame:
    return ratings.quality_added(f.quality_coefs, ratings.side_counts(
        state.event_roster(f.sequence, f.roster)))


def _skill(f: Feed) -> DataFrame:
    return ratings.skill_added(f.skill, ratings.season_engagements(f.sequence, f.roster))


def _xkill(f: Feed) -> DataFrame:
    """Normalised expected kills of the model fitted on the feed."""
    steps = feed.engagements(f.sequence, gap_cap_ms=30000)
    return jobs.xkill_normalised(steps, jobs.xkill_fit(f.pairs))


RELATIONAL: dict[str, Callable[[Feed], DataFrame]] = {
    "mode_deaths": lambda f: feed.mode_deaths(f.events, f.match_info),
    "event_sequence": lambda f: f.sequence,
    "engagement_long": lambda f: f.long.drop("role_ord", "victim", "other_player"),
    "life_streak": lambda f: feed.life_streak(f.long).select(
        *EVENT, "type", "player", "tsla", "life", "streak", "pdk", "pkk", "first_eng"),
    "trade_flags": lambda f: f.steps.select(
        *EVENT, "type", "player", "last_kill_id", "last_kill_s", "in_trade_eng", "win", "traded"),
    "opponent": lambda f: feed.opponent(f.long),
    "was_traded": lambda f: trades.was_traded(f.outcomes),
    "trade_outcomes": lambda f: f.outcomes,
    "trades_only": lambda f: trades.trades_only(f.outcomes),
    "trade_engs": lambda f: trades.trade_engs(f.outcomes),
    "trade_roles_long": _roles,
    "trade_role_matrix": lambda f: trades.trade_role_matrix(_roles(f), PLAYERS),
    "xor_trades": lambda f: trades.xor_trades(_steps15(f)),
    "non_trades": lambda f: trades.non_trades(_steps15(f)),
    "trade_triplets": lambda f: trades.trade_triplets(_steps15(f)),
    "trade_triplets_strict": lambda f: trades.trade_triplets(_steps15(f), strict=True),
    "trade_triplet_matrix": lambda f: trades.trade_triplet_matrix(_state_triplets(f), PLAYERS),
    "state_by_role": _by_role,
    "trade_success": lambda f: trades.trade_success(
        _by_role(f), ["4v4", "3v4"], "TRADE", MIN_SITUATIONS, MIN_SITUATIONS // 2),
    "trade_success_against": lambda f: trades.trade_success(
        _by_role(f), ["4v4", "4v3"], "AGAINST", MIN_SITUATIONS, MIN_SITUATIONS // 2),
    "trade_success_dead": lambda f: trades.trade_success(
        _by_role(f), ["4v4", "4v3"], "DEAD", MIN_SITUATIONS, MIN_SITUATIONS // 2),
    "trade_counts": lambda f: trades.trade_counts(f.outcomes),
    "player_trade_rates": _rates,
    "player_trade_rates_old": lambda f: trades.player_trade_rates_old(
        trades.trade_counts(f.outcomes), MIN_N),
    "player_trade_percentiles": _rates_long,
    "xkill_pairs": lambda f: f.pairs,
    "xkill_closed_form": lambda f: xkill.xkill_closed_form(f.pairs).drop("other_in_trade"),
    "trade_situation": lambda f: _situations(f).drop("state"),
    "engagement_matrix": lambda f: xkill.engagement_matrix(
        rounded(_situations(f)), PLAYERS),
    "event_roster": lambda f: state.event_roster(f.sequence, f.roster),
    "alive_flags": lambda f: f.alive,
    "alive_matrix": lambda f: state.alive_matrix(f.alive, PLAYERS),
    "trader_matrix": lambda f: state.trader_matrix(f.alive, PLAYERS),
    "manpower_state": lambda f: f.states.drop("id", "attacker_id"),
    "state_shifts": lambda f: state.state_shifts(f.states).drop("id", "attacker_id"),
    "engagement_pace": lambda f: state.engagement_pace(f.states),
    "team_advantage": lambda f: _team_rows(f).drop("role_ord"),
    "time_at_advantage": lambda f: state.time_at_advantage(_team_rows(f)),
    "time_at_advantage_wide": _times_wide,
    "team_plus_minus": _plus_minus,
    "advantage_vs_score": lambda f: state.advantage_vs_score(_times_wide(f), _plus_minus(f)),
    "match_with_difference": lambda f: state.match_with_difference(
        state.advantage_vs_score(_times_wide(f), _plus_minus(f)), 2),
    "advantage_profile": lambda f: state.advantage_profile(
        state.time_at_advantage(_team_rows(f))),
    "advantage_timeline": lambda f: state.advantage_timeline(_team_rows(f)),
    "player_time_alive": lambda f: state.player_time_alive(f.alive),
    "eligible_players": lambda f: state.eligible_players(f.roster, MIN_GAMES),
    "engagement_rate": lambda f: state.engagement_rate(f.boxscores, f.match_info),
    "tidy_terms": lambda f: ratings.tidy_terms(
        f.trade_terms.withColumn("term", F.concat("term", F.lit("TRUE")))),
    "player_betas": _betas,
    "player_probabilities": _probabilities,
    "player_probabilities_unconditional": lambda f: ratings.player_probabilities(
        _betas(f), unconditional=True).select(
            "player_id", "p_traded_kill", "p_two_piece", "p_fail_trade", "p_traded_death"),
    "expected_engagement_value": lambda f: ratings.expected_engagement_value(_probabilities(f)),
    "expected_kills_added": lambda f: ratings.expected_kills_added(
        ratings.expected_engagement_value(_probabilities(f)), ratings.engagement_counts(f.long),
        ratings.time_played(f.boxscores, f.match_info, "Hardpoint")),
    "value_per_10min": lambda f: ratings.value_per_10min(_probabilities(f), _box(f)),
    "coef_percentiles": _coefs_long,
    "impact_vs_actual": lambda f: ratings.impact_vs_actual(_coefs_long(f), _rates_long(f)),
    "box_stats": _box,
    "pace_added": _pace,
    "quality_added": _quality,
    "skill_added": _skill,
    "player_war": lambda f: ratings.player_war(
        _pace(f), _quality(f), _skill(f), ratings.roster_games(f.roster)),
    "win_by_differential": lambda f: tables.win_by_differential(_plus_minus(f, "Hardpoint")),
    "match_details": lambda f: tables.match_details(f.match_info, f.match_scores),
    "season_stats": _seasons,
    "season_games": lambda f: tables.season_games(_seasons(f)),
    "year_over_year_corr": lambda f: tables.year_over_year_corr(_seasons(f), SEASON_GAMES),
    "first_groups": lambda f: feed.first_groups(f.sequence, "match_id", 5),
    "one_per_group": lambda f: xkill.one_per_group(
        f.steps.select(*EVENT, "type", "player"), EVENT, "type"),
    "train_test_split": lambda f: f.sequence.select(
        *EVENT, (design.hash_share(EVENT, 7) < 750_000).alias("is_train")),
    "varying_terms": lambda f: _varying(f),
    "odds_ratio_delta": lambda f: _betas(f).join(_rates(f), "player_id").select(
        "player_id", odds_ratio_delta(F.col("beta_1"), F.col("kill_pct")).alias("delta")),
    "predictions_by_adv": lambda f: fits.predictions_by(
        _situations(f), ["win", "adv"], "pred_win"),
    "predicted_by_state": lambda f: _predicted_by_state(f),
    "closed_form_grid": lambda f: _closed_form_grid(f),
    "xkill_confusion": lambda f: fits.confusion(
        xkill.xkill_closed_form(f.pairs), "win", "pred_win"),
    "trade_attempted_design": lambda f: _design(jobs.trade_attempted_rows(_outcome_alive(f))),
    "trade_won_design": lambda f: _design(jobs.trade_won_rows(_roles(f, with_state=True))),
    "duel_design": lambda f: _design(
        jobs.duel_rows(_situations(f)), "player", "outcome", "pred_win"),
    "triplet_design": lambda f: _design(jobs.triplet_rows(_state_triplets(f))),
    "pace_design": lambda f: _design(jobs.pace_rows(
        state.engagement_pace(jobs.side_terms(f.alive))), "model_ms"),
    "win_design": lambda f: jobs.win_rows(_plus_minus(f, "Hardpoint")),
}


def _design(rows: DataFrame, *more: str) -> DataFrame:
    """A design matrix in long form: a row for every term that holds."""
    return rows.select(*EVENT, *(more or ["outcome"]), F.explode("terms").alias("term")).filter(
        F.col("term").isNotNull())


def _varying(f: Feed) -> DataFrame:
    rows = design.collect_terms(
        _roles(f), EVENT, F.concat_ws("_", "player_id", "p"), F.lit(True))
    terms = [f"{p}_{r}" for p in PLAYERS for r in ("P1", "P2", "P3")]
    varying = design.varying_terms(rows, terms)
    return design.term_counts(rows, F.col("term").isin(varying))


def _outcome_alive(f: Feed) -> DataFrame:
    return state.alive_flags(state.event_roster(f.outcomes, f.roster))


def _grid(f: Feed) -> DataFrame:
    """Model probabilities over the observed streaks and a range of gaps."""
    pairs = jobs.xkill_inputs(f.pairs)
    grid = fits.prediction_grid(
        pairs, ["pkk_x", "pkk_y"], {"tsla_x": (0, 5000, 100), "tsla_y": (0, 5000, 1000)}
    ).withColumn("both", F.col("pkk_x") * F.col("pkk_y"))
    fit = jobs.xkill_fit(f.pairs)
    return fits.predict(fit[0], grid, fit[1])


def _closed_form_grid(f: Feed) -> DataFrame:
    """The published duel model over the observed streaks and a range of gaps."""
    grid = fits.prediction_grid(
        f.pairs, ["pkk_x", "pkk_y"], {"tsla_x": (0, 5000, 100), "tsla_y": (0, 5000, 1000)})
    return grid.select("*", xkill.closed_form_probability().alias("pred_win"))


MODELS: dict[str, Callable[[Feed], DataFrame]] = {
    "xkill_model": lambda f: jobs.xkill_model(f.pairs),
    "xkill_normalised": _xkill,
    "xkill_predictions": lambda f: jobs.xkill_predictions(f.pairs, jobs.xkill_fit(f.pairs)),
    "xkill_grid": _grid,
    "trade_attempted_model": lambda f: jobs.trade_attempted_model(
        _outcome_alive(f), f.roster, min_games=MIN_GAMES),
    "stop_trade_model": lambda f: jobs.stop_trade_model(
        _outcome_alive(f), f.roster, roles=("AGAINST", "DEAD"), min_games=MIN_GAMES),
    "trade_won_model": lambda f: jobs.trade_won_model(
        _roles(f, with_state=True), f.roster, min_games=MIN_GAMES),
    "duel_model": lambda f: jobs.duel_model(_situations(f), f.roster, min_games=MIN_GAMES),
    "win_model": lambda f: jobs.win_model(_plus_minus(f, "Hardpoint")),
    "triplet_model": lambda f: jobs.triplet_model(_state_triplets(f), f.roster),
    "talent_model": lambda f: jobs.talent_model(_xkill(f), f.roster, MIN_GAMES),
    "talent_log_loss": lambda f: jobs.talent_log_loss(_xkill(f), f.roster, MIN_GAMES),
    "shot_quality_model": lambda f: jobs.shot_quality_model(
        _xkill(f), _shifts(f), f.roster, MIN_GAMES),
    "shot_quality_ranking": lambda f: fits.side_ranking(
        jobs.shot_quality_model(_xkill(f), _shifts(f), f.roster, MIN_GAMES)),
    "shot_quality_grid": lambda f: jobs.shot_quality_grid(
        _xkill(f), _shifts(f), f.roster, MIN_GAMES),
    "pace_model": lambda f: jobs.pace_table(jobs.pace_fit(
        state.engagement_pace(jobs.side_terms(f.alive)), f.roster, MIN_GAMES)),
}


# From the feed to ratings by the models' own coefficients, as a user runs them.


def _numbered(f: Feed) -> Feed:
    """The feed with its numbered events and roster settled: these queries read them often."""
    f.sequence, f.roster = settle(f.sequence), settle(f.roster)
    return f


def _fitted_skill(f: Feed, xkill: DataFrame) -> DataFrame:
    return jobs.talent_model(xkill, f.roster, MIN_GAMES)


def _fitted_probabilities(f: Feed) -> DataFrame:
    f = _numbered(f)
    tried = jobs.trade_attempted_model(_outcome_alive(f), f.roster, min_games=MIN_GAMES)
    won = jobs.trade_won_model(_roles(f, with_state=True), f.roster, min_games=MIN_GAMES)
    betas = ratings.player_betas(_fitted_skill(f, _xkill(f)), tried.dropna(subset=["estimate"]),
                                 won.dropna(subset=["estimate"]))
    return ratings.players_only(ratings.player_probabilities(betas))


def _fitted_war(f: Feed) -> DataFrame:
    f = _numbered(f)
    alive, games, scored = f.alive, ratings.roster_games(f.roster), _xkill(f)
    with design.settled(jobs.side_terms(alive)) as sides:
        pace = jobs.pace_table(jobs.pace_fit(
            state.engagement_pace(sides), f.roster, MIN_GAMES))
        quality = jobs.shot_quality_model(scored, state.state_shifts(sides), f.roster, MIN_GAMES)
    return ratings.player_war(
        ratings.pace_added(ratings.side_values(pace), state.player_time_alive(alive), games),
        ratings.quality_added(ratings.side_values(quality), ratings.side_counts(
            state.event_roster(f.sequence, f.roster))),
        ratings.skill_added(
            _fitted_skill(f, scored), ratings.season_engagements(f.sequence, f.roster)),
        games)


MODELS |= {
    "fitted_probabilities": _fitted_probabilities,
    "fitted_expected_kills": lambda f: ratings.expected_kills_added(
        ratings.expected_engagement_value(_fitted_probabilities(f)),
        ratings.engagement_counts(f.long),
        ratings.time_played(f.boxscores, f.match_info, "Hardpoint")),
    "fitted_war": _fitted_war,
}


def _predicted_by_state(f: Feed) -> DataFrame:
    """Expected and actual wins of the killer's side in the common states."""
    common = fits.common_levels(_situations(f), "state", 100)
    return common.groupBy("state", "n").agg(
        F.avg("pred_win").alias("mean_pred"), F.avg(F.col("win").cast("int")).alias("mean_win"))


def all_queries() -> dict[str, Query]:
    return {name: on(build) for name, build in {**RELATIONAL, **MODELS}.items()}
