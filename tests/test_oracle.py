"""Every query with a SQL form gives the same rows on both engines."""

import pytest

import __spark_entry__ as contract
from checks import registry
from checks.compare import compare, duck

from .conftest import SMALL

SQL = contract.oracle_sql()
# Above their thresholds only from the next larger test data on, where they are compared.
LARGER = {"player_trade_rates", "player_trade_rates_old", "player_trade_percentiles",
          "odds_ratio_delta", "eligible_players", "year_over_year_corr", "trade_success",
          "trade_success_against", "trade_success_dead", "match_with_difference",
          "box_stats"}


NEXT = SMALL.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def con():
    return {path: duck(path) for path in (SMALL, NEXT)}


@pytest.mark.parametrize("name", sorted(registry.RELATIONAL))
def test_same_rows(spark, con, name):
    path = NEXT if name in LARGER else SMALL
    outcome = compare(spark, con[path], path, name, contract.queries()[name], SQL[name])
    assert outcome.startswith("ok"), outcome


def test_contract(spark):
    queries = contract.queries()
    assert set(SQL) <= set(queries)
    assert set(registry.all_queries()) - set(SQL) == set(registry.MODELS)
    flagship = contract.entry(spark)
    assert flagship.count() > 0
