"""Hand-made feeds."""

DEATHS = "match_id string, time_ms long, id string, attacker_id string"
TEAM_A, TEAM_B = ["a1", "a2", "a3", "a4"], ["b1", "b2", "b3", "b4"]


def deaths(spark, *events, match="m"):
    """Events as (time, victim, killer)."""
    return spark.createDataFrame([(match, *e) for e in events], DEATHS)


def roster(spark, match="m", extra=()):
    rows = [(match, p, "A") for p in TEAM_A] + [(match, p, "B") for p in TEAM_B]
    return spark.createDataFrame([*rows, *extra], "match_id string, player_id string, team string")


def keyed(df, keys, *values):
    """Rows as {key: value(s)}."""
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys) if len(keys) > 1 else row[keys[0]]
        value = tuple(row[v] for v in values) if len(values) > 1 else row[values[0]]
        assert key not in out
        out[key] = value
    return out
