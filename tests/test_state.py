from pyspark.sql import functions as F

from duelwise.operators import feed, state

from .helpers import TEAM_A, TEAM_B, deaths, keyed, roster


def alive_of(spark, *events, extra=()):
    sequence = feed.event_sequence(deaths(spark, *events))
    return sequence, state.alive_flags(state.event_roster(sequence, roster(spark, extra=extra)))


def test_respawn_edge_is_strict(spark):
    _, alive = alive_of(spark, (10000, "a1", "b1"), (14000, "b2", "a2"), (14001, "b3", "a2"),
                        (18000, "a3", "b4"))
    a1 = keyed(alive.filter("player_id = 'a1'"), ["event_id"], "alive", "type")
    assert a1 == {1: (1, "AGAINST"), 2: (0, "FOR"), 3: (1, "FOR"), 4: (1, "AGAINST")}


def test_a_second_fall_is_compared_with_its_own_return(spark):
    _, alive = alive_of(spark, (10000, "a1", "b1"), (12000, "a1", "b1"), (13000, "b2", "a2"))
    assert keyed(alive.filter("player_id = 'a1'"), ["event_id"], "alive") == {1: 1, 2: 1, 3: 0}


def test_equal_times_and_time_zero(spark):
    _, alive = alive_of(spark, (0, "a1", "b1"), (9000, "a2", "b1"), (9000, "b2", "a3"))
    at = alive.groupBy("event_id").agg(F.sum("alive").alias("n"))
    # At 0 ms only the victim counts; at a tie everyone but the later victim is out.
    assert keyed(at, ["event_id"], "n") == {1: 1, 2: 8, 3: 1}


def test_unknown_killers_leave_everyone_against(spark):
    sequence, alive = alive_of(spark, (9000, "a1", None), (20000, "a2", "stranger"))
    states = keyed(state.manpower_state(alive), ["event_id"], "state", "adv")
    assert states == {1: ("0v8", -8), 2: ("0v8", -8)}


def test_one_state_row_per_event_within_roster_size(spark):
    events = [(1500 * i + 1000, TEAM_A[i % 4] if i % 3 else TEAM_B[i % 4],
               TEAM_B[i % 4] if i % 3 else TEAM_A[i % 4]) for i in range(40)]
    sequence, alive = alive_of(spark, *events)
    states = state.manpower_state(alive)
    assert states.count() == sequence.count() == 40
    assert states.filter("for_alive > 4 or against_alive > 4 or for_alive < 0").count() == 0
    shifts = state.state_shifts(states).orderBy("event_id").collect()
    everything = states.orderBy("event_id").collect()
    expected, last, index = [], "4v4", 0
    for row in everything:
        changed = row.state != last
        index += changed
        if changed or not expected:
            expected.append((row.event_id, index))
        last = row.state
    assert [(r.event_id, r.shift_index) for r in shifts] == expected


def test_pace_and_lengths(spark):
    sequence, alive = alive_of(spark, (3000, "a1", "b1"), (9000, "a2", "b1"), (9000, "b2", "a3"))
    pace = keyed(state.engagement_pace(state.manpower_state(alive)), ["event_id"],
                 "duration", "epm", "model_ms")
    assert pace == {1: (None, None, None), 2: (6000, 10.0, 6000), 3: (0, None, 1)}
    assert keyed(state.event_lengths(sequence), ["event_id"], "event_len") == {1: 3000, 2: 6000, 3: 0}


def test_team_views_mirror_each_other(spark):
    sequence, alive = alive_of(spark, (10000, "a1", "b1"), (12000, "a2", "b1"), (13000, "b2", "a3"))
    states = state.manpower_state(alive)
    rows = state.team_advantage(states, roster(spark))
    assert rows.groupBy("event_id").agg(F.sum("adv").alias("s")).filter("s <> 0").count() == 0
    a = keyed(rows.filter("team = 'A'"), ["event_id"], "adv", "previous_adv", "event_len")
    assert a == {1: (0, 0, 10000), 2: (-1, 0, 2000), 3: (-2, -1, 1000)}
    times = state.time_at_advantage(rows)
    assert keyed(times.filter("team = 'B'"), ["adv"], "time") == {0: 10000, 1: 2000, 2: 1000}
    wide = state.time_at_advantage_wide(times, [-2, -1, 0, 1, 2])
    profile = state.advantage_profile(times, "m")
    assert keyed(profile, ["team", "adv"], "time") == {("B", 1): 2000, ("B", 2): 1000}
    line = keyed(state.advantage_timeline(rows, "m", "B"), ["event_id"], "cum_adv")
    assert line == {1: 0, 2: 1, 3: 3}


def test_time_alive_counts_the_gap_before_each_event(spark):
    _, alive = alive_of(spark, (10000, "a1", "b1"), (12000, "a2", "b1"), (20000, "b2", "a3"))
    got = keyed(state.player_time_alive(alive).filter("player_id = 'a1'"), ["type"], "toi", "engs")
    assert got == {"AGAINST": (10000, 2), "FOR": (8000, 1)}


def test_a_player_without_events_is_alive_throughout(spark):
    _, alive = alive_of(spark, (10000, "a1", "b1"), (12000, "a2", "b1"))
    assert keyed(alive.filter("player_id = 'b4'"), ["event_id"], "alive") == {1: 1, 2: 1}


def test_trader_roles(spark):
    _, alive = alive_of(spark, (10000, "a1", "b1"))
    roles = keyed(state.trader_roles(alive), ["player_id"], "type")
    assert roles == {"a1": "DEAD", "a2": "AGAINST", "a3": "AGAINST", "a4": "AGAINST", "b1": "KILLER"}


def test_a_numbered_feed_keeps_the_partitions_of_the_session(spark):
    # Merged by bytes, few tasks would hold every event once per player.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sequence, alive = alive_of(spark, (10000, "a1", "b1"), (14000, "b2", "a2"))
    assert sequence.rdd.getNumPartitions() == alive.rdd.getNumPartitions() == parts


def test_matrices_take_one_group_per_event(spark, capsys):
    seats = [(1, "a1", "AGAINST", 1), (1, "a2", "FOR", 1), (1, "a2", "FOR", 1),
             (1, "other", "FOR", 1), (2, "a1", "AGAINST", 0), (2, "a2", "FOR", None)]
    alive = spark.createDataFrame(
        [("m", e, 1000 * e, "v", p, t, n) for e, p, t, n in seats],
        "match_id string, event_id long, time_ms long, id string, player_id string, "
        "type string, alive int")
    wide = state.alive_matrix(alive, ["a1", "a2", "nobody"])
    wide.explain()
    assert "pivot" not in capsys.readouterr().out
    names = [f"{p}_{s}" for p in ("a1", "a2", "nobody") for s in ("AGAINST", "FOR")]
    # Of a player listed twice both rows count.
    assert keyed(wide, ["event_id"], *names) == {1: (1, 0, 0, 2, 0, 0), 2: (0,) * 6}
