from pyspark.sql import functions as F

from duelwise.operators import feed, trades, xkill
from duelwise.operators.scan import scan

from .helpers import deaths, keyed


def steps_of(spark, *events, **options):
    return feed.engagements(feed.event_sequence(deaths(spark, *events)), **options)


def test_filter_keeps_one_type_and_mode(spark):
    events = spark.createDataFrame(
        [("m", 1, "death", "a", "b"), ("m", 2, "spawn", "a", None), ("n", 3, "death", "a", "b")],
        "match_id string, time_ms long, type string, id string, attacker_id string")
    info = spark.createDataFrame([("m", "Hardpoint"), ("n", "Search")], "match_id string, mode string")
    assert feed.mode_deaths(events, info).collect() == [("m", 1, "a", "b")]


def test_sequence_breaks_ties_by_victim_then_killer(spark):
    rows = feed.event_sequence(deaths(spark, (5, "b1", "a1"), (5, "a1", "b1"), (0, "a2", "b1")))
    assert keyed(rows, ["event_id"], "id") == {1: "a2", 2: "a1", 3: "b1"}


def test_long_has_the_victim_first(spark):
    rows = feed.engagement_long(feed.event_sequence(deaths(spark, (9, "a1", "b1"))))
    assert [(r.type, r.role_ord, r.player, r.other_player) for r in rows.orderBy("role_ord").collect()] == [
        ("id", 0, "a1", "b1"), ("attacker_id", 1, "b1", "a1")]


def test_lives_streaks_and_windows(spark):
    rows = steps_of(
        spark,
        (4999, "b1", "a1"),    # 1: first action before 5 s: after-respawn for both
        (9998, "b2", "a1"),    # 2: a1 again, +4999: answered in time
        (14998, "b3", "a1"),   # 3: +5000: too late
        (19000, "a1", "b1"),   # 4: a1 falls
        (60000, "b4", "a1"),   # 5: a1 back after 41 s: capped gap, new life
    )
    a1 = keyed(rows.filter("player = 'a1'"), ["event_id"],
               "tsla", "life", "streak", "pdk", "in_trade_eng", "last_kill_id")
    assert a1 == {
        1: (4999, 1, 0, True, False, None),
        2: (4999, 1, 1, False, True, 1),
        3: (5000, 1, 2, False, False, 2),
        4: (4002, 1, 3, False, True, 3),
        5: (15000, 2, 0, False, False, None),
    }
    first = keyed(rows.filter("player = 'b2'"), ["event_id"], "pdk", "tsla")
    assert first == {2: (False, 9998)}
    wide = steps_of(spark, (1, "b1", "a1"), (40000, "b1", "a1"), gap_cap_ms=30000)
    assert wide.agg(F.max("tsla")).first()[0] == 30000


def test_self_kill_and_missing_killer(spark):
    rows = steps_of(spark, (6000, "a1", "a1"), (7000, "a1", "b1"), (8000, "b1", None))
    a1 = keyed(rows.filter("player = 'a1'"), ["event_id", "type"], "life", "streak", "last_kill_id")
    # The fall comes first inside the event, so the kill opens the second life.
    assert a1 == {(1, "id"): (1, 0, None), (1, "attacker_id"): (2, 0, None), (2, "id"): (2, 1, 1)}
    assert rows.filter("player is null").count() == 1


def test_outcomes_equal_the_join_on_the_previous_kill(spark):
    sequence = feed.event_sequence(deaths(
        spark, (6000, "b1", "a1"), (7000, "a1", "b2"), (8000, "a2", "b2"), (30000, "b2", "a3"),
        (30500, "a3", "a3"), (31000, "b1", "a3"), (31500, "a4", None), (32000, "b2", None)))
    outcomes = trades.trade_outcomes(feed.engagement_long(sequence))
    steps = feed.engagements(sequence).filter("in_trade_eng").select(
        "match_id", F.col("last_kill_id").alias("event_id"), "other_player",
        F.col("in_trade_eng").alias("trade_att"), F.col("traded").alias("trade_win"))
    joined = sequence.join(steps, ["match_id", "event_id"], "left").select(*outcomes.columns)
    assert sorted(map(str, outcomes.collect())) == sorted(map(str, joined.collect()))
    assert keyed(trades.was_traded(outcomes), ["event_id"], "in_trade_eng")[1] is True
    assert keyed(trades.trade_engs(outcomes), ["event_id"], "player", "win")[1] == ("a1", False)


def test_one_sided_trades_and_the_fan_out(spark):
    events = [
        (20000, "b1", "a1"),   # 1
        (30000, "b2", "a2"),   # 2: a2's kill
        (32000, "a2", "b3"),   # 3: b3 avenges b2
        (33000, "a1", "b3"),   # 4: b3 in trade; a1 has an old kill (13 s)
    ]
    steps = steps_of(spark, *events)
    rows = trades.trade_triplets(steps)
    at3 = sorted((r.type, r.player, r.win) for r in rows.filter("event_id = 3").collect())
    assert at3 == [("AGAINST", "a2", True), ("DEAD", "b2", True), ("TRADE", "b3", True)]
    fallen = [r.player for r in rows.filter("event_id = 4 and type = 'DEAD'").collect()]
    assert sorted(fallen) == ["a2", "b1"]
    strict = trades.trade_triplets(steps, strict=True)
    assert [r.player for r in strict.filter("event_id = 4 and type = 'DEAD'").collect()] == ["a2"]
    marked = trades.marked_trades(steps)
    assert marked.filter("trade_kill and event_id = 4").count() == 2


def test_both_in_trade(spark):
    steps = steps_of(spark, (20000, "b1", "a1"), (21000, "a2", "b2"), (22000, "a1", "b2"),
                     gap_cap_ms=30000)
    states = steps.select("match_id", "event_id").distinct().withColumn("adv", F.lit(1))
    rows = xkill.trade_situation(xkill.xkill_closed_form(xkill.xkill_pairs(steps)), states)
    got = keyed(rows.filter("event_id = 3"), ["player"], "trade_sit", "adv")
    assert got == {"a1": ("BOTH", -1), "b2": ("BOTH", 1)}
    sums = rows.groupBy("event_id").agg(F.sum("pred_win").alias("p"))
    assert all(abs(r.p - 1) < 1e-12 for r in sums.collect())


def test_situations_come_in_pairs(spark):
    steps = steps_of(spark, (20000, "b1", "a1"), (22000, "a1", "b2"), (60000, "a1", "b2"),
                     gap_cap_ms=30000)
    states = steps.select("match_id", "event_id").distinct().withColumn("adv", F.lit(0))
    rows = xkill.trade_situation(xkill.xkill_closed_form(xkill.xkill_pairs(steps)), states)
    counts = keyed(rows.groupBy("trade_sit").count(), ["trade_sit"], "count")
    assert counts == {"SOLO": 1, "OTHER": 1, "NONE": 4}


def test_partitioning_does_not_change_results(spark):
    events = [(1000 * i, f"a{i % 4}", f"b{i % 3}") for i in range(1, 60)]
    wide = deaths(spark, *events).repartition(7)
    one = deaths(spark, *events).coalesce(1)
    rows = [sorted(map(str, feed.engagements(feed.event_sequence(d)).collect())) for d in (wide, one)]
    assert rows[0] == rows[1]


def test_scan_looks_back_and_ahead(spark):
    rows = spark.range(5).selectExpr("'g' g", "id o", "id * 10 v")
    back = keyed(scan(rows, ["g"], ["o"], previous={"p": "v"}, total={"t": F.col("v")},
                      peak={"m": F.col("v")}, number="n"), ["o"], "p", "t", "m", "n")
    assert back[0] == (None, 0, None, 1) and back[4] == (30, 100, 30, 5)
    ahead = keyed(scan(rows, ["g"], ["o"], previous={"p": "v"}, descending=True), ["o"], "p")
    assert ahead == {0: 10, 1: 20, 2: 30, 3: 40, 4: None}
