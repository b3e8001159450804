"""Ordered scans spread over tasks, whatever share of the rows one match or moment holds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from checks.compare import rows_of
from checks.registry import RELATIONAL, rounded
from duelwise.operators import feed, scan as scans, state
from duelwise.operators.ranking import percent_rank_by
from duelwise.sources.testdata import Feed

from .conftest import SMALL
from .helpers import DEATHS, roster

SCANS = [
    "event_sequence", "life_streak", "trade_flags", "trade_outcomes", "trade_triplets",
    "xor_trades", "xkill_closed_form", "event_roster", "alive_flags", "trader_matrix",
    "manpower_state", "state_shifts", "engagement_pace", "team_advantage",
    "advantage_timeline", "player_time_alive",
]


@pytest.fixture
def blocks(spark):
    """Sets the events of a block; matches are whole again after the test."""
    yield lambda size: spark.conf.set(scans.BLOCK_SETTING, str(size))
    spark.conf.unset(scans.BLOCK_SETTING)
    spark.catalog.clearCache()


@pytest.fixture
def spread(spark):
    """More partitions, and none of them merged for being small."""
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set(merging, "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set(merging, "true")


@pytest.mark.parametrize("name", SCANS)
def test_blocks_give_the_rows_of_whole_matches(spark, blocks, name):
    build = RELATIONAL[name]
    whole = rounded(build(Feed(spark, SMALL)))
    columns = whole.columns
    whole = rows_of(columns, whole.collect())
    blocks(29)
    cut = rounded(build(Feed(spark, SMALL)))
    assert cut.columns == columns
    assert rows_of(columns, cut.collect()) == whole
    assert whole[1]


def hot_feed(spark, n=12_000):
    """Nine of ten rows in one match, half of these at one moment, with ties in all keys."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        match = "hot" if i % 10 else f"m{i % 70}"
        time = 500 if match == "hot" and i % 2 else rng.randrange(1000)
        rows.append((match, time, f"a{rng.randrange(4) + 1}", f"b{rng.randrange(4) + 1}", i))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, DEATHS + ", rn long").repartition(4)


def shares(df, of):
    """The largest share of the rows in one task."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    return max(sizes) / of


def test_hot_match_and_burst_spread_over_tasks(spark, spread):
    rows, deaths = hot_feed(spark)
    placed = scans.placed_rows(deaths, ["match_id"], ["time_ms", "rn"])
    assert shares(placed, len(rows)) < 0.25
    numbered = scans.number_rows(deaths, ["match_id"], ["time_ms", "rn"], "event_id")
    assert numbered.columns == [*deaths.columns, "event_id"]
    assert shares(numbered, len(rows)) < 0.25
    got = {(r.match_id, r.rn): r.event_id for r in numbered.collect()}
    want, seen = {}, {}
    for match, time, _, _, rn in sorted(rows, key=lambda r: (r[0], r[1], r[4])):
        seen[match] = seen.get(match, 0) + 1
        want[match, rn] = seen[match]
    assert got == want


@pytest.mark.parametrize("size", [0, 100])
def test_equal_rows_get_numbers_of_their_own(spark, blocks, size):
    blocks(size)
    rows = [("m", 5, "a1", "b1")] * 300 + [("n", 5, "a1", "b1"), ("n", 4, "a2", "b2")]
    found = feed.event_sequence(spark.createDataFrame(rows, DEATHS)).collect()
    assert sorted(r.event_id for r in found if r.match_id == "m") == list(range(1, 301))
    assert {(r.time_ms, r.event_id) for r in found if r.match_id == "n"} == {(4, 1), (5, 2)}
    assert feed.event_sequence(spark.createDataFrame([], DEATHS)).count() == 0


@pytest.mark.parametrize("size", [0, 500])
def test_lives_of_a_hot_match_are_the_plain_ones(spark, blocks, spread, size):
    blocks(size)
    rows, deaths = hot_feed(spark, 6_000)
    sequence = feed.event_sequence(deaths, "rn")
    lives = feed.life_streak(feed.engagement_long(sequence)).filter("match_id = 'hot'")
    got = {(r.event_id, r.type): (r.life, r.streak, r.tsla) for r in lives.collect()}
    life, streak, last, want = {}, {}, {}, {}
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[1], r[4]))
    for number, (_, time, victim, killer, _) in enumerate(hot, 1):
        for kind, player in (("id", victim), ("attacker_id", killer)):
            gap = time - last.get(player, 0)
            want[number, kind] = (
                life.setdefault(player, 1), streak.setdefault(player, 0), min(gap, 15000))
            last[player] = time
            if kind == "id":
                life[player], streak[player] = life[player] + 1, 0
            else:
                streak[player] += 1
    assert got == want
    states = state.states_of(sequence, roster(spark, "hot")).filter("match_id = 'hot'")
    assert states.count() == len(hot)
    if size:
        assert shares(states, len(hot)) < 0.6



@pytest.mark.parametrize("name", ["event_sequence", "life_streak", "trade_outcomes",
                                  "alive_flags", "manpower_state"])
def test_rows_are_not_shuffled_on_the_match_alone(spark, blocks, name):
    """Roster and carried rows may be; rows of the feed go by match and block, or by range."""
    blocks(1 << 20)
    f = Feed(spark, SMALL)
    plan = RELATIONAL[name](f)._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        assert not re.search(r"Exchange hashpartitioning\(match_id#\d+, \d+\)", line), line


def plain_ranks(rows, descending=False):
    out = []
    for group, value, i in rows:
        own = [v for g, v, _ in rows if g == group and v is not None and v == v]
        if value is None or value != value:
            out.append((group, i, None))
        else:
            less = sum(v > value if descending else v < value for v in own)
            out.append((group, i, less / (len(own) - 1) if len(own) > 1 else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("descending", [False, True])
def test_percent_ranks_with_a_common_value(spark, descending):
    rng = random.Random(8)
    rows = [("a", 1.5 if i % 3 else rng.choice([rng.random() * 3, None, float("nan"), -0.0, 0.0]), i)
            for i in range(900)]
    rows += [("b", float(rng.randrange(5)), i) for i in range(60)]
    rows += [("one", 3.0, 0), ("none", None, 0), (None, 1.0, 1), (None, 2.0, 2)]
    df = spark.createDataFrame(rows, "stat string, value double, i int").repartition(3)
    ranked = percent_rank_by(df, "stat", descending=descending)
    got = sorted(((r.stat, r.i, r.percentile) for r in ranked.collect()), key=str)
    assert got == plain_ranks(rows, descending)
    assert ranked.columns == ["stat", "value", "i", "percentile"]


def test_a_common_value_makes_no_large_task(spark, spread):
    df = spark.range(9_000).selectExpr("'s' stat", "if(id % 3 = 0, id, -1) value").repartition(4)
    ranked = percent_rank_by(df, "stat")
    assert shares(ranked, 9_000) < 0.25
    ranks = dict(ranked.select("value", "percentile").distinct().collect())
    assert ranks[-1] == 0 and ranks[0] == 6000 / 8999 and len(ranks) == 3001
