"""Ratings from the models' own coefficients: the job tables go into the plans as they are."""

import math

import pytest
from pyspark.sql import functions as F

from checks import registry
from duelwise import params
from duelwise.models import jobs
from duelwise.plans import ratings
from duelwise.sources.testdata import Feed

from .conftest import SMALL
from .helpers import keyed

NEXT = SMALL.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def tables(spark):
    """The three job tables behind the probabilities."""
    f = Feed(spark, NEXT)
    return (
        keyed(jobs.talent_model(registry._xkill(f), f.roster, registry.MIN_GAMES), ["name"], "estimate"),
        keyed(jobs.trade_attempted_model(
            registry._outcome_alive(f), f.roster, min_games=registry.MIN_GAMES), ["term"], "estimate"),
        keyed(jobs.trade_won_model(registry._roles(f, with_state=True), f.roster,
                                   min_games=registry.MIN_GAMES), ["player", "type"], "estimate"))


def chance(odds):
    return None if odds is None else odds / (1 + odds)


def test_probabilities_from_fitted_coefficients(spark, tables):
    skill, tried, won = tables
    found = keyed(registry._fitted_probabilities(Feed(spark, NEXT)), ["player_id"], *(
        f"beta_{i}" for i in range(1, 6)), "p_kill", "p_trade_att_kill", "p_two_piece", "p_fail_trade")
    assert set(found) == set(skill) - {"(Intercept)", "kill_prob"} and len(found) == 23

    def times(odds, *factors):
        return None if odds is None else odds * math.prod(factors)

    close = lambda a, b: (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9)
    some = 0
    for player, (b1, b2, b3, b4, b5, kill, try_kill, two, fail) in found.items():
        want = [
            math.exp(skill[player] + params.SKILL_INTERCEPT + params.SKILL_AT * params.SKILL_SLOPE),
            times(tried.get(f"{player}_KILLER"), params.TRADE_BASE, params.TRADE_ADV, params.TRADE_OTHER_KILLER),
            times(tried.get(f"{player}_DEAD"), params.TRADE_BASE, params.TRADE_ADV, params.TRADE_OTHER_DEAD),
            times(won.get((player, "P1")), params.WON_BASE, params.WON_OTHER_P1, params.WON_ADV),
            times(won.get((player, "P2")), params.WON_BASE, params.WON_OTHER_P2, params.WON_ADV)]
        assert all(map(close, (b1, b2, b3, b4, b5), want))
        assert close(kill, chance(want[0])) and close(try_kill, chance(want[1]))
        if None not in want:
            some += 1
            assert close(two, (1 - chance(want[3])) * chance(want[1]))
            assert close(fail, chance(want[4]) * chance(want[2]))
    # All but the baseline player, and those whose terms others explain.
    assert some >= 18


def test_sides_without_coefficient_have_no_row(spark):
    table = spark.createDataFrame(
        [("a", 0.0, 1.5, 0.0), ("b", 0.0, -0.5, 2.0), ("4v4", 3.0, 0.0, 0.0)],
        "name string, base double, `FOR` double, AGAINST double")
    assert keyed(ratings.side_values(table), ["player_id", "name"], "value") == {
        ("a", "FOR"): 1.5, ("b", "FOR"): -0.5, ("b", "AGAINST"): 2.0}


def test_war_adds_up_from_fitted_parts(spark):
    war = registry._fitted_war(Feed(spark, NEXT)).filter(F.col("pm_g").isNotNull()).collect()
    assert len(war) > 15
    assert [r.pm_g for r in war] == sorted((r.pm_g for r in war), reverse=True)
    for r in war:
        assert math.isclose(r.wapr, r.pm_g * params.WINS_PER_KILL, rel_tol=1e-12)
        assert math.isfinite(r.kapr) and math.isfinite(r.pm_total)
