"""The queries again in SQL, for a second engine on the same Parquet tables.

Each statement is a chain of common table expressions and a final select. The forms differ
from the Spark ones on purpose where that makes the check independent: trades are found by
joining the feed with itself, states by joining roster rows, ranks by ``rank()``.
"""

from __future__ import annotations

PLAYERS = sorted(f"PLAYER{i}" for i in range(23))

CTES = """
raw AS (
  SELECT event_id // 100 AS m, event_id % 100 AS rn,
    CASE WHEN event_type = 'signup' THEN 'spawn' ELSE 'death' END AS type,
    user_id % 8 AS vs, event_id, CAST(round(value * 100) AS BIGINT) AS c
  FROM events),
seat_raw AS (
  SELECT m, rn, type, vs, rn * 2500 + c % 2500 AS time_ms,
    CASE WHEN vs < 4 THEN 4 ELSE 0 END + (event_id * 7 + c) % 4 AS ks
  FROM raw),
feed AS (
  SELECT 'M' || m AS match_id, time_ms, type, 'PLAYER' || ((m + 3 * vs) % 23) AS id,
    'PLAYER' || ((m + 3 * ks) % 23) AS attacker_id, rn
  FROM seat_raw),
ms AS (SELECT DISTINCT m FROM raw),
info AS (
  SELECT 'M' || m AS match_id, CASE WHEN m % 3 = 0 THEN 'Search' ELSE 'Hardpoint' END AS mode,
    'MAP' || (m % 4) AS map, CAST(250000 AS BIGINT) AS duration_ms,
    CASE WHEN m % 3 = 0 THEN 11 ELSE 1 END AS rounds,
    CASE (m // 3) % 3 WHEN 0 THEN 1485907200 WHEN 1 THEN 1517443200 ELSE 1548979200 END
      + 3600 * m AS start_time_s
  FROM ms),
seats AS (
  SELECT ms.m, s.seat,
    (SELECT count(*) FROM seat_raw r WHERE r.m = ms.m AND r.ks = s.seat AND r.type = 'death') AS kills,
    (SELECT count(*) FROM seat_raw r WHERE r.m = ms.m AND r.vs = s.seat AND r.type = 'death') AS deaths
  FROM ms, (SELECT unnest(range(8)) AS seat) s),
box AS (
  SELECT 'M' || m AS match_id, 'PLAYER' || ((m + 3 * seat) % 23) AS name,
    CASE WHEN seat < 4 THEN 'A' ELSE 'B' END AS team, kills, deaths
  FROM seats),
team_kills AS (
  SELECT m, sum(CASE WHEN seat < 4 THEN kills ELSE 0 END) AS a,
    sum(CASE WHEN seat < 4 THEN 0 ELSE kills END) AS b
  FROM seats GROUP BY m),
scores AS (
  SELECT 'M' || m AS match_id, 'A' AS name, CAST(100 + a AS INTEGER) AS score,
    a - b + (m * 37 % 21) - 10 > 0 AS is_victor FROM team_kills
  UNION ALL
  SELECT 'M' || m, 'B', CAST(100 + b AS INTEGER), NOT (a - b + (m * 37 % 21) - 10 > 0)
  FROM team_kills),
roster AS (SELECT match_id, name AS player_id, team FROM box),
deaths AS (
  SELECT f.match_id, f.time_ms, f.id, f.attacker_id, f.rn
  FROM feed f LEFT JOIN info i ON f.match_id = i.match_id
  WHERE f.type = 'death' AND i.mode = 'Hardpoint'),
seq AS (
  SELECT match_id, time_ms, id, attacker_id,
    row_number() OVER (PARTITION BY match_id ORDER BY time_ms, rn) AS event_id
  FROM deaths),
long AS (
  SELECT match_id, event_id, time_ms, 'id' AS type, 0 AS role_ord, id AS player,
    attacker_id AS other_player FROM seq
  UNION ALL
  SELECT match_id, event_id, time_ms, 'attacker_id', 1, attacker_id, id FROM seq),
gaps AS (
  SELECT *, time_ms - lag(time_ms, 1, 0) OVER w AS gap,
    CASE WHEN lag(type, 1, 'id') OVER w = 'id' THEN 1 ELSE 0 END AS starts
  FROM long WINDOW w AS (PARTITION BY match_id, player ORDER BY event_id, role_ord)),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY match_id, player ORDER BY event_id, role_ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS life
  FROM gaps),
lives AS (
  SELECT *, row_number() OVER l - 1 AS streak, lag(event_id) OVER l AS last_kill_id,
    time_ms - lag(time_ms, 1, 0) OVER l AS last_kill_s
  FROM numbered WINDOW l AS (PARTITION BY match_id, player, life ORDER BY event_id, role_ord)),
steps AS (
  SELECT match_id, event_id, time_ms, type, role_ord, player, other_player,
    CAST(life AS BIGINT) AS life, streak, least(15000, gap) AS tsla,
    least(15000, gap) < 5000 AND streak = 0 AS pdk, streak > 0 AS pkk, streak = 0 AS first_eng,
    last_kill_id, last_kill_s,
    streak >= 1 AND last_kill_s < 5000 AS in_trade_eng,
    streak >= 1 AND last_kill_s < 15000 AS in_long_trade,
    type = 'attacker_id' AS win, type = 'id' AS traded, least(30000, gap) AS tsla30
  FROM lives),
outcomes AS (
  SELECT s.match_id, s.event_id, s.time_ms, s.id, s.attacker_id, t.other_player,
    t.in_trade_eng AS trade_att, t.traded AS trade_win
  FROM seq s LEFT JOIN (SELECT * FROM steps WHERE in_trade_eng) t
    ON s.match_id = t.match_id AND s.event_id = t.last_kill_id),
roles AS (
  SELECT match_id, event_id, trade_win AS traded, 'P1' AS p, attacker_id AS player_id
  FROM outcomes WHERE trade_att
  UNION ALL SELECT match_id, event_id, trade_win, 'P2', id FROM outcomes WHERE trade_att
  UNION ALL SELECT match_id, event_id, trade_win, 'P3', other_player FROM outcomes WHERE trade_att),
marked AS (
  SELECT match_id, event_id, type, player, pdk, last_kill_id, in_long_trade AS in_trade_eng, win,
    bool_or(in_long_trade) OVER e AND NOT bool_and(in_long_trade) OVER e AS trade_kill
  FROM steps WINDOW e AS (PARTITION BY match_id, event_id)),
only_trades AS (SELECT * FROM marked WHERE NOT pdk AND trade_kill),
fallen AS (
  SELECT o.match_id, o.event_id, s.id AS player, o.in_trade_eng
  FROM only_trades o JOIN seq s ON o.match_id = s.match_id AND o.last_kill_id = s.event_id),
trios AS (
  SELECT w.match_id, w.event_id, w.against, w.trade, f.player AS dead, f.in_trade_eng,
    s.attacker_id = w.trade AS win
  FROM (SELECT match_id, event_id, max(CASE WHEN in_trade_eng THEN player END) AS against,
          max(CASE WHEN NOT in_trade_eng THEN player END) AS trade
        FROM only_trades GROUP BY match_id, event_id) w
  JOIN fallen f ON w.match_id = f.match_id AND w.event_id = f.event_id
  JOIN seq s ON w.match_id = s.match_id AND w.event_id = s.event_id),
triplets AS (
  SELECT match_id, event_id, win, 'AGAINST' AS type, against AS player FROM trios
  UNION ALL SELECT match_id, event_id, win, 'TRADE', trade FROM trios
  UNION ALL SELECT match_id, event_id, win, 'DEAD', dead FROM trios),
counts AS (
  SELECT player_id, type, trade_att, trade_win, count(*) AS n FROM (
    SELECT id AS player_id, 'id' AS type, trade_att, trade_win FROM outcomes
    UNION ALL SELECT attacker_id, 'attacker_id', trade_att, trade_win FROM outcomes
    UNION ALL SELECT other_player, 'other_player', trade_att, trade_win FROM outcomes)
  GROUP BY ALL),
rate_sums AS (
  SELECT player_id,
    sum(CASE WHEN type = 'attacker_id' THEN n ELSE 0 END) AS k,
    sum(CASE WHEN type = 'id' THEN n ELSE 0 END) AS d,
    sum(CASE WHEN type = 'attacker_id' AND trade_att THEN n ELSE 0 END) AS ka,
    sum(CASE WHEN type = 'attacker_id' AND trade_att AND trade_win THEN n ELSE 0 END) AS kw,
    sum(CASE WHEN type = 'attacker_id' AND trade_att AND NOT trade_win THEN n ELSE 0 END) AS kl,
    sum(CASE WHEN type = 'id' AND trade_att THEN n ELSE 0 END) AS da,
    sum(CASE WHEN type = 'id' AND trade_att AND trade_win THEN n ELSE 0 END) AS dw,
    sum(CASE WHEN type = 'id' AND trade_att AND NOT trade_win THEN n ELSE 0 END) AS dl,
    CAST(sum(n) AS BIGINT) AS n
  FROM counts GROUP BY player_id),
rates AS (
  SELECT player_id, k / nullif(k + d, 0) AS kill_pct, 1 - k / nullif(k + d, 0) AS death_pct,
    ka / nullif(k, 0) AS trade_att_kill_pct, 1 - ka / nullif(k, 0) AS no_trade_att_kill_pct,
    kw / nullif(k, 0) AS traded_kill_pct, kl / nullif(k, 0) AS two_piece_pct,
    da / nullif(d, 0) AS trade_att_death_pct, 1 - da / nullif(d, 0) AS no_trade_att_death_pct,
    dw / nullif(d, 0) AS traded_death_pct, dl / nullif(d, 0) AS failed_trade_death_pct, n
  FROM rate_sums),
ev_roster AS (
  SELECT s.match_id, s.event_id, s.time_ms, s.id, s.attacker_id, r.player_id,
    CASE WHEN r.team = k.team THEN 'FOR' ELSE 'AGAINST' END AS type
  FROM seq s LEFT JOIN roster r ON s.match_id = r.match_id
  LEFT JOIN roster k ON s.match_id = k.match_id AND s.attacker_id = k.player_id),
alive AS (
  SELECT match_id, event_id, time_ms, id, attacker_id, player_id, type,
    CASE WHEN greatest(0, coalesce(max(time_back) OVER (PARTITION BY match_id, player_id
      ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) < time_back
      THEN 1 ELSE 0 END AS alive
  FROM (SELECT *, time_ms + CASE WHEN id = player_id THEN 4000 ELSE 0 END AS time_back
        FROM ev_roster)),
sides AS (
  SELECT match_id, event_id, time_ms,
    CAST(sum(CASE WHEN type = 'FOR' THEN alive ELSE 0 END) AS BIGINT) AS for_alive,
    CAST(sum(CASE WHEN type = 'AGAINST' THEN alive ELSE 0 END) AS BIGINT) AS against_alive
  FROM alive GROUP BY match_id, event_id, time_ms),
states AS (
  SELECT *, for_alive || 'v' || against_alive AS state, for_alive - against_alive AS adv
  FROM sides),
timed AS (
  SELECT match_id, event_id, state, CASE WHEN duration = 0 THEN 1 ELSE duration END AS model_ms
  FROM (SELECT *, time_ms - lag(time_ms) OVER (PARTITION BY match_id ORDER BY event_id) AS duration
        FROM states)
  WHERE duration IS NOT NULL),
seen AS (
  SELECT t.match_id, t.event_id, t.win, t.type, t.player,
    CASE WHEN t.win = (t.type IN ('TRADE', 'DEAD'))
      THEN split_part(s.state, 'v', 1) || 'v' || split_part(s.state, 'v', 2)
      WHEN NOT (t.win = (t.type IN ('TRADE', 'DEAD')))
      THEN split_part(s.state, 'v', 2) || 'v' || split_part(s.state, 'v', 1) END AS state
  FROM triplets t LEFT JOIN states s ON t.match_id = s.match_id AND t.event_id = s.event_id),
lens AS (
  SELECT *, time_ms - lag(time_ms, 1, 0) OVER (PARTITION BY match_id ORDER BY event_id) AS event_len
  FROM seq),
team_rows AS (
  SELECT l.match_id, l.event_id, l.time_ms, n.event_len, l.type, l.role_ord, l.player, r.team,
    CASE WHEN l.type = 'id' THEN -s.adv ELSE s.adv END AS adv
  FROM long l JOIN lens n ON l.match_id = n.match_id AND l.event_id = n.event_id
  LEFT JOIN roster r ON l.match_id = r.match_id AND l.player = r.player_id
  LEFT JOIN states s ON l.match_id = s.match_id AND l.event_id = s.event_id),
team_adv AS (
  SELECT *, lag(adv, 1, 0) OVER (PARTITION BY match_id, team ORDER BY event_id, role_ord) AS previous_adv
  FROM team_rows),
times AS (
  SELECT match_id, team, adv, CAST(sum(event_len) AS BIGINT) AS time
  FROM team_adv GROUP BY match_id, team, adv),
times_wide AS (
  SELECT match_id, team, {TIME_COLUMNS}
  FROM times GROUP BY match_id, team),
pm_all AS (
  SELECT b.match_id, b.team, b.engs, b.pm, s.score, s.is_victor
  FROM (SELECT match_id, team, CAST(sum(kills) + sum(deaths) AS BIGINT) AS engs,
          CAST(sum(kills) - sum(deaths) AS BIGINT) AS pm FROM box GROUP BY match_id, team) b
  LEFT JOIN scores s ON b.match_id = s.match_id AND b.team = s.name),
pm_mode AS (
  SELECT p.* FROM pm_all p JOIN info i ON p.match_id = i.match_id WHERE i.mode = 'Hardpoint'),
toi AS (
  SELECT player_id, type, CAST(sum(CASE WHEN alive = 1 THEN duration ELSE 0 END) AS BIGINT) AS toi,
    count(*) AS engs
  FROM (SELECT *, time_ms - lag(time_ms, 1, 0) OVER (PARTITION BY match_id, player_id
          ORDER BY event_id) AS duration FROM alive)
  GROUP BY player_id, type),
hashed AS (
  SELECT *, md5(match_id || '|' || event_id || '|' || type || '|0') AS h FROM steps),
duels AS (
  SELECT v.match_id, v.event_id, v.h < k.h AS y_is_victim,
    v.player AS v_player, v.pkk AS v_pkk, v.tsla30 AS v_tsla, v.in_trade_eng AS v_trade,
    k.player AS k_player, k.pkk AS k_pkk, k.tsla30 AS k_tsla, k.in_trade_eng AS k_trade
  FROM hashed v JOIN hashed k ON v.match_id = k.match_id AND v.event_id = k.event_id
  WHERE v.type = 'id' AND k.type = 'attacker_id' AND NOT v.pdk AND NOT k.pdk),
pairs AS (
  SELECT match_id, event_id, y_is_victim AS win_x, NOT y_is_victim AS win_y,
    CASE WHEN y_is_victim THEN k_player ELSE v_player END AS player_x,
    CASE WHEN y_is_victim THEN k_pkk ELSE v_pkk END AS pkk_x,
    CASE WHEN y_is_victim THEN k_tsla ELSE v_tsla END AS tsla_x,
    CASE WHEN y_is_victim THEN k_trade ELSE v_trade END AS in_trade_x,
    CASE WHEN y_is_victim THEN v_player ELSE k_player END AS player_y,
    CASE WHEN y_is_victim THEN v_pkk ELSE k_pkk END AS pkk_y,
    CASE WHEN y_is_victim THEN v_tsla ELSE k_tsla END AS tsla_y,
    CASE WHEN y_is_victim THEN v_trade ELSE k_trade END AS in_trade_y
  FROM duels),
odds AS (
  SELECT *, exp(0.254 * CAST(pkk_x AS INTEGER) + 2.79e-5 * tsla_x - 0.254 * CAST(pkk_y AS INTEGER)
    - 2.79e-5 * tsla_y - 0.0117 * CAST(pkk_x AND pkk_y AS INTEGER)) AS o
  FROM pairs),
scored AS (
  SELECT match_id, event_id, player_x AS player, o / (1 + o) AS pred_win, win_x AS win,
    in_trade_x AS in_trade FROM odds
  UNION ALL
  SELECT match_id, event_id, player_y, 1 - o / (1 + o), win_y, in_trade_y FROM odds),
situations AS (
  SELECT c.match_id, c.event_id, c.player, c.pred_win, c.win, c.in_trade,
    CASE WHEN bool_and(c.in_trade) OVER e THEN 'BOTH' WHEN c.in_trade THEN 'SOLO'
      WHEN bool_or(c.in_trade) OVER e THEN 'OTHER' ELSE 'NONE' END AS trade_sit,
    CASE WHEN c.win THEN s.adv ELSE -s.adv END AS adv
  FROM scored c LEFT JOIN states s ON c.match_id = s.match_id AND c.event_id = s.event_id
  WINDOW e AS (PARTITION BY c.match_id, c.event_id)),
skill AS (
  SELECT player AS name, ln(odds) AS estimate, odds, odds / (1 + odds) AS prob FROM (
    SELECT player, (count(*) FILTER (type = 'attacker_id') + 1)
      / (count(*) FILTER (type = 'id') + 1) AS odds FROM long GROUP BY player)),
trade_terms AS (
  SELECT player || '_' || type AS term, (h + 1) / (n - h + 1) AS estimate FROM (
    SELECT player, type, count(*) AS n, count(*) FILTER (hit) AS h FROM (
      SELECT attacker_id AS player, 'KILLER' AS type, coalesce(trade_att, false) AS hit FROM outcomes
      UNION ALL SELECT id, 'DEAD', coalesce(trade_att, false) FROM outcomes)
    GROUP BY player, type)),
won_roles AS (
  SELECT player_id AS player, p AS type,
    (count(*) FILTER (traded) + 1) / (count(*) FILTER (NOT traded) + 1) AS estimate
  FROM roles GROUP BY player_id, p),
betas AS (
  SELECT s.name AS player_id, exp(s.estimate + -3.88 + 0.5 * 7.64) AS beta_1,
    exp(ln(k.estimate) + ln(0.909) + ln(1.13) + ln(0.828)) AS beta_2,
    exp(ln(d.estimate) + ln(0.909) + ln(1.13) + ln(1.4)) AS beta_3,
    exp(ln(p1.estimate) + ln(1.68) + ln(1.17) + ln(1.01)) AS beta_4,
    exp(ln(p2.estimate) + ln(1.68) + ln(0.91) + ln(1.01)) AS beta_5
  FROM skill s LEFT JOIN trade_terms k ON k.term = s.name || '_KILLER'
  LEFT JOIN trade_terms d ON d.term = s.name || '_DEAD'
  LEFT JOIN won_roles p1 ON p1.player = s.name AND p1.type = 'P1'
  LEFT JOIN won_roles p2 ON p2.player = s.name AND p2.type = 'P2'),
shares AS (
  SELECT *, beta_1 / (1 + beta_1) AS b1, beta_2 / (1 + beta_2) AS b2, beta_3 / (1 + beta_3) AS b3,
    beta_4 / (1 + beta_4) AS b4, beta_5 / (1 + beta_5) AS b5 FROM betas),
probs AS (
  SELECT player_id, beta_1, beta_2, beta_3, beta_4, beta_5, b1 AS p_kill, 1 - b1 AS p_death,
    b2 AS p_trade_att_kill, 1 - b2 AS p_no_trade_att_kill, b4 * b2 AS p_traded_kill,
    (1 - b4) * b2 AS p_two_piece, b3 AS p_trade_att_death, 1 - b3 AS p_no_trade_att_death,
    b5 * b3 AS p_fail_trade, (1 - b5) * b3 AS p_traded_death
  FROM shares),
box_table AS (
  SELECT name, sum(kills) / nullif(sum(deaths), 0) AS kd, sum(duration_ms) / 1000 AS time_s,
    sum(kills) / (sum(duration_ms) / 1000) * 60 AS kpm,
    (sum(kills) + sum(deaths)) / (sum(duration_ms) / 1000) * 60 AS epm
  FROM box JOIN info USING (match_id) GROUP BY name
  HAVING sum(duration_ms) / 1000 > {BOX_MIN_TIME}),
games AS (SELECT player_id, count(*) AS games FROM roster GROUP BY player_id),
pace_coefs AS (
  SELECT player_id, type AS name,
    engs / nullif(toi, 0) / (SELECT sum(engs) / sum(toi) FROM toi) AS value FROM toi),
quality_coefs AS (
  SELECT player_id, type AS name, avg(alive) - 0.75 AS value FROM alive GROUP BY player_id, type),
pace AS (
  SELECT player_id, sum(CASE WHEN name = 'FOR' THEN engs ELSE -engs END)
    - sum(CASE WHEN name = 'FOR' THEN potential ELSE -potential END) AS pm_added_pace
  FROM (SELECT c.player_id, c.name, t.engs, engs / (toi / 1000) / value * (toi / 1000) AS potential
        FROM pace_coefs c JOIN toi t ON c.player_id = t.player_id AND c.name = t.type)
  GROUP BY player_id),
side_counts AS (
  SELECT player_id, type, count(*) AS n, count(DISTINCT match_id) AS games
  FROM ev_roster GROUP BY player_id, type),
quality AS (
  SELECT c.player_id,
    sum(CASE WHEN c.name = 'AGAINST' THEN -c.value * s.n ELSE c.value * s.n END * 2) AS pm_added_total,
    coalesce(max(CASE WHEN c.name = 'FOR' THEN s.games END), max(s.games)) AS games
  FROM quality_coefs c JOIN side_counts s ON c.player_id = s.player_id AND c.name = s.type
  GROUP BY c.player_id),
own AS (
  SELECT player_id, count(*) AS eng, count(DISTINCT match_id) AS games
  FROM ev_roster WHERE player_id = id OR player_id = attacker_id GROUP BY player_id),
skill_pm AS (
  SELECT s.name AS player_id, (o.eng * s.prob - o.eng * 0.5) * 2 AS pm_added_skill,
    (o.eng * s.prob - o.eng * 0.5) * 2 / o.games AS kapr_skill
  FROM skill s JOIN own o ON s.name = o.player_id),
seasons AS (
  SELECT CASE WHEN make_timestamp(start_time_s * 1000000) < TIMESTAMP '2017-10-01' THEN 1
      WHEN make_timestamp(start_time_s * 1000000) < TIMESTAMP '2018-10-01' THEN 2
      WHEN make_timestamp(start_time_s * 1000000) < TIMESTAMP '2019-10-01' THEN 3 END AS year_no,
    CASE WHEN make_timestamp(start_time_s * 1000000) < TIMESTAMP '2017-10-01' THEN 'IW'
      WHEN make_timestamp(start_time_s * 1000000) < TIMESTAMP '2018-10-01' THEN 'WWII'
      WHEN make_timestamp(start_time_s * 1000000) < TIMESTAMP '2019-10-01' THEN 'BO4' END AS title,
    mode, lower(name) AS player, CAST(sum(kills) AS BIGINT) AS kills,
    CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(rounds) AS BIGINT) AS rounds, count(*) AS n,
    sum(kills) / nullif(sum(deaths), 0) AS kd
  FROM box LEFT JOIN info USING (match_id) GROUP BY 1, 2, 3, 4)
"""

# Four seats a side.
LEVELS = list(range(-4, 5))
RATE_NAMES = [
    "kill_pct", "death_pct", "trade_att_kill_pct", "no_trade_att_kill_pct", "traded_kill_pct",
    "two_piece_pct", "trade_att_death_pct", "no_trade_att_death_pct", "traded_death_pct",
    "failed_trade_death_pct",
]
PROB_NAMES = [
    "p_kill", "p_death", "p_trade_att_kill", "p_no_trade_att_kill", "p_traded_kill",
    "p_two_piece", "p_trade_att_death", "p_no_trade_att_death", "p_fail_trade", "p_traded_death",
]
BETA_NAMES = [f"beta_{i}" for i in range(1, 6)]


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _presence(rows: str, ids: list[str], term: str, terms: list[str]) -> str:
    cells = ", ".join(f"coalesce(bool_or({term} = '{t}'), false) AS \"{t}\"" for t in terms)
    keys = ", ".join(ids)
    return f"SELECT {keys}, {cells} FROM {rows} GROUP BY {keys}"


def _sums(rows: str, ids: list[str], term: str, value: str, terms: list[str]) -> str:
    cells = ", ".join(
        f"CAST(sum(CASE WHEN {term} = '{t}' THEN {value} ELSE 0 END) AS BIGINT) AS \"{t}\""
        for t in terms
    )
    keys = ", ".join(ids)
    return f"SELECT {keys}, {cells} FROM {rows} GROUP BY {keys}"


def _terms(roles: list[str]) -> list[str]:
    return sorted(f"{p}_{r}" for p in PLAYERS for r in roles)


def _gather(rows: str, ids: list[str], stats: list[str], name: str = "stat") -> str:
    keys = ", ".join(ids)
    return " UNION ALL ".join(
        f"SELECT {keys}, '{s}' AS {name}, CAST({s} AS DOUBLE) AS value FROM {rows}" for s in stats
    )


def _percentile(group: str = "stat") -> str:
    return (
        f"CASE WHEN value IS NOT NULL THEN round((rank() OVER (PARTITION BY {group}, value IS NULL"
        f" ORDER BY value) - 1) / nullif(count(value) OVER (PARTITION BY {group}) - 1, 0), 6) END"
        " AS percentile"
    )


def statements(
    min_n: int = 200, box_min_time: int = 6000, min_games: int = 10, min_situations: int = 20,
    season_games: int = 2,
) -> dict[str, str]:
    """SQL per query. The thresholds are those of the registry."""
    time_columns = ", ".join(
        f'max(CASE WHEN adv = {a} THEN time END) AS "{a}"' for a in LEVELS
    )
    chain = "WITH " + CTES.replace("{TIME_COLUMNS}", time_columns).replace(
        "{BOX_MIN_TIME}", str(box_min_time)
    )
    state_columns = "match_id, event_id, time_ms, for_alive, against_alive, state, adv"
    shown_rates = f"SELECT * FROM rates WHERE n > {min_n}"
    long_rates = _gather(f"({shown_rates})", ["player_id"], RATE_NAMES + ["n"])
    ranked_rates = (
        f"SELECT player_id, stat, round(value, 6) AS value, {_percentile()} FROM ({long_rates})"
    )
    coef_rows = _gather("probs", ["player_id"], BETA_NAMES + PROB_NAMES, "name")
    coef_ranked = (
        f"SELECT player_id, name, round(value, 6) AS value, {_percentile('name')},"
        f" round(avg(value) OVER (PARTITION BY name), 6) AS avg FROM ({coef_rows})"
    )
    labels = {
        "Gunfight Win%": ("p_kill", "kill_pct", 1),
        "Kill - No Trade Attempt%": ("p_no_trade_att_kill", "no_trade_att_kill_pct", 2),
        "Get Two-Piece": ("p_two_piece", "two_piece_pct", 3),
        "Death - Trade Attempt%": ("p_trade_att_death", "trade_att_death_pct", 4),
        "Death Traded Success%": ("p_traded_death", "traded_death_pct", 5),
    }
    recoded = "CASE {c} " + " ".join(
        f"WHEN '{p}' THEN '{label}' WHEN '{r}' THEN '{label}'"
        for label, (p, r, _) in labels.items()
    ) + " END"
    place = "CASE {c} " + " ".join(
        f"WHEN '{p}' THEN {o} WHEN '{r}' THEN {o}" for p, r, o in labels.values()
    ) + " END"
    impacts = ", ".join(f"'{p}'" for p, _, _ in labels.values())
    actuals = ", ".join(f"'{r}'" for _, r, _ in labels.values())
    value10 = (
        "(-p_death * p_no_trade_att_death - p_death * p_fail_trade + p_kill * p_trade_att_kill"
        " + p_kill * p_two_piece) * epm * 10"
    )
    exp_eng = "p_trade_att_kill + p_two_piece * 2 - p_trade_att_death - p_fail_trade * 2"
    kapm = (
        "SELECT p.player_id, exp_eng, n, exp_eng * n AS added, time_s, exp_eng * n / time_s * 60 AS kapm"
        f" FROM (SELECT player_id, {exp_eng} AS exp_eng FROM probs) p"
        " LEFT JOIN (SELECT player, count(*) AS n FROM long GROUP BY player) c ON c.player = p.player_id"
        " LEFT JOIN (SELECT name, sum(duration_ms) / 1000 AS time_s FROM box JOIN info USING (match_id)"
        " WHERE mode = 'Hardpoint' GROUP BY name) t ON t.name = p.player_id"
    )
    stat_next = (
        "SELECT a.name, a.value, b.value AS next_year FROM ({s}) a LEFT JOIN ({s}) b"
        " ON a.player = b.player AND a.name = b.name AND a.mode = b.mode AND b.year_no = a.year_no + 1"
    ).format(s=(
        "SELECT year_no, mode, player, 'kd' AS name, kd AS value FROM seasons WHERE n > {g}"
        " UNION ALL SELECT year_no, mode, player, 'kpr', kills / nullif(rounds, 0) FROM seasons"
        " WHERE n > {g}"
    ).format(g=season_games))

    def success(states: list[str], role: str) -> str:
        inside = ", ".join(f"'{s}'" for s in states)
        table = (
            "SELECT player, type, CAST(sum(CAST(win AS INTEGER)) AS BIGINT) AS w,"
            " avg(CAST(win AS INTEGER)) AS w_pct, count(*) AS n, count(DISTINCT match_id) AS games"
            f" FROM seen WHERE state IN ({inside}) AND type = '{role}' GROUP BY player, type"
        )
        return (
            "SELECT player, type, w, n - w AS l, round(w_pct, 6) AS w_pct, round(1 - w_pct, 6) AS l_pct, n,"
            " round(n / games, 6) AS sit_per_game,"
            f" round((SELECT avg(w_pct) FROM ({table}) WHERE n > {min_situations // 2}), 6) AS league_w_pct,"
            f" round(1 - (SELECT avg(w_pct) FROM ({table}) WHERE n > {min_situations // 2}), 6) AS league_l_pct"
            f" FROM ({table}) WHERE n > {min_situations}"
        )

    bodies = {
        "mode_deaths": "SELECT match_id, time_ms, id, attacker_id FROM deaths",
        "event_sequence": "SELECT match_id, event_id, time_ms, id, attacker_id FROM seq",
        "engagement_long": "SELECT match_id, event_id, time_ms, type, player FROM long",
        "life_streak": "SELECT match_id, event_id, type, player, tsla, life, streak, pdk, pkk, first_eng FROM steps",
        "trade_flags": "SELECT match_id, event_id, type, player, last_kill_id, last_kill_s, in_trade_eng, win, traded FROM steps",
        "opponent": "SELECT match_id, event_id, type, player, other_player FROM long",
        "was_traded": "SELECT match_id, event_id, time_ms, id, attacker_id, coalesce(trade_att, false) AS in_trade_eng FROM outcomes",
        "trade_outcomes": "SELECT match_id, event_id, time_ms, id, attacker_id, other_player, trade_att, trade_win FROM outcomes",
        "trades_only": "SELECT match_id, event_id, time_ms, id, attacker_id, attacker_id AS player, other_player, trade_att AS in_trade_eng, trade_win AS traded FROM outcomes WHERE trade_win IS NOT NULL",
        "trade_engs": "SELECT match_id, event_id, attacker_id AS player, NOT trade_win AS win FROM outcomes WHERE trade_att",
        "trade_roles_long": "SELECT match_id, event_id, traded, p, player_id FROM roles",
        "trade_role_matrix": _presence("roles", ["match_id", "event_id", "traded"], "player_id || '_' || p", _terms(["P1", "P2", "P3"])),
        "xor_trades": "SELECT match_id, event_id, type, player, pdk, last_kill_id, in_trade_eng, win, trade_kill FROM only_trades",
        "non_trades": "SELECT match_id, event_id, type, player, pdk, last_kill_id, in_trade_eng, win, trade_kill FROM marked WHERE NOT pdk AND NOT trade_kill",
        "trade_triplets": "SELECT match_id, event_id, win, type, player FROM triplets",
        "trade_triplets_strict": "SELECT match_id, event_id, win, 'AGAINST' AS type, against AS player FROM trios WHERE in_trade_eng UNION ALL SELECT match_id, event_id, win, 'TRADE', trade FROM trios WHERE in_trade_eng UNION ALL SELECT match_id, event_id, win, 'DEAD', dead FROM trios WHERE in_trade_eng",
        "trade_triplet_matrix": "SELECT w.*, s.state FROM (" + _presence("triplets", ["match_id", "event_id", "win"], "player || '_' || type", _terms(["AGAINST", "DEAD", "TRADE"])) + ") w LEFT JOIN states s USING (match_id, event_id)",
        "state_by_role": "SELECT match_id, event_id, win, type, player, state FROM seen",
        "trade_success": success(["4v4", "3v4"], "TRADE"),
        "trade_success_against": success(["4v4", "4v3"], "AGAINST"),
        "trade_success_dead": success(["4v4", "4v3"], "DEAD"),
        "trade_counts": "SELECT player_id, type, trade_att, trade_win, n FROM counts",
        "player_trade_rates": f"SELECT player_id, {_r(*RATE_NAMES)}, n FROM ({shown_rates})",
        "player_trade_rates_old": f"SELECT player_id, round(ka / nullif(k, 0), 6) AS kills_traded_pct, round(da / nullif(d, 0), 6) AS deaths_traded_pct, round(kl / nullif(ka, 0), 6) AS got_two_pct, round(dl / nullif(da, 0), 6) AS failed_death_trade, n FROM rate_sums WHERE n > {min_n}",
        "player_trade_percentiles": ranked_rates,
        "xkill_pairs": "SELECT match_id, event_id, player_x, pkk_x, tsla_x, in_trade_x, win_x, player_y, pkk_y, tsla_y, in_trade_y, win_y FROM pairs",
        "xkill_closed_form": f"SELECT match_id, event_id, player, {_r('pred_win')}, win, in_trade FROM scored",
        "trade_situation": f"SELECT match_id, event_id, player, {_r('pred_win')}, win, in_trade, trade_sit, adv FROM situations",
        "engagement_matrix": _presence("(SELECT match_id, event_id, round(pred_win, 6) AS pred_win, win, in_trade, trade_sit, adv, player FROM situations)", ["match_id", "event_id", "pred_win", "win", "in_trade", "trade_sit", "adv"], "player || '_ENG'", [f"{p}_ENG" for p in PLAYERS]),
        "event_roster": "SELECT match_id, event_id, time_ms, id, attacker_id, player_id, type FROM ev_roster",
        "alive_flags": "SELECT match_id, event_id, time_ms, id, attacker_id, player_id, type, alive FROM alive",
        "alive_matrix": _sums("alive", ["match_id", "event_id", "time_ms", "id"], "player_id || '_' || type", "alive", _terms(["AGAINST", "FOR"])),
        "trader_matrix": _sums("(SELECT match_id, event_id, alive, player_id, CASE WHEN player_id = id THEN 'DEAD' WHEN player_id = attacker_id THEN 'KILLER' ELSE type END AS role FROM alive)", ["match_id", "event_id"], "player_id || '_' || role", "alive", _terms(["AGAINST", "DEAD", "KILLER"])),
        "manpower_state": f"SELECT {state_columns} FROM states",
        "state_shifts": "SELECT match_id, event_id, time_ms, state, adv, shift_index FROM (SELECT *, row_number() OVER (PARTITION BY match_id, shift_index ORDER BY event_id) AS first FROM (SELECT *, CAST(sum(changed) OVER (PARTITION BY match_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shift_index FROM (SELECT *, CASE WHEN state <> lag(state, 1, '4v4') OVER (PARTITION BY match_id ORDER BY event_id) THEN 1 ELSE 0 END AS changed FROM states))) WHERE first = 1",
        "engagement_pace": "SELECT match_id, event_id, state, adv, duration, round(60000.0 / nullif(duration, 0), 6) AS epm, 1 AS shot, CASE WHEN duration = 0 THEN 1 ELSE duration END AS model_ms FROM (SELECT *, time_ms - lag(time_ms) OVER (PARTITION BY match_id ORDER BY event_id) AS duration FROM states)",
        "team_advantage": "SELECT match_id, event_id, time_ms, event_len, type, player, team, adv, previous_adv FROM team_adv",
        "time_at_advantage": "SELECT match_id, team, adv, time FROM times",
        "time_at_advantage_wide": "SELECT * FROM times_wide",
        "team_plus_minus": "SELECT match_id, team, engs, pm, score, is_victor FROM pm_all",
        "advantage_vs_score": "SELECT w.*, p.engs, p.pm, p.score, p.is_victor FROM times_wide w LEFT JOIN pm_all p USING (match_id, team)",
        "match_with_difference": "SELECT match_id, team, pm FROM times_wide JOIN pm_all USING (match_id, team) WHERE pm = 2 ORDER BY match_id, team LIMIT 1",
        "advantage_profile": "SELECT match_id, team, adv, time FROM times WHERE adv > 0",
        "advantage_timeline": "SELECT match_id, event_id, type, team, time_ms, CAST(sum(adv) OVER (PARTITION BY match_id, team ORDER BY event_id, role_ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_adv FROM team_adv",
        "player_time_alive": "SELECT player_id, type, toi, engs FROM toi",
        "eligible_players": f"SELECT player_id, games AS n FROM games WHERE games > {min_games}",
        "engagement_rate": "SELECT round(avg(rate), 6) AS ms_per_eng FROM (SELECT match_id, sum(kills) / avg(duration_ms / 1000) AS rate FROM box JOIN info USING (match_id) WHERE mode = 'Hardpoint' GROUP BY match_id)",
        "tidy_terms": f"SELECT split_part(term, '_', 1) AS player, split_part(term, '_', 2) AS type, {_r('estimate')} FROM trade_terms",
        "player_betas": f"SELECT player_id, {_r(*BETA_NAMES)} FROM betas",
        "player_probabilities": f"SELECT player_id, {_r(*BETA_NAMES, *PROB_NAMES)} FROM probs",
        "player_probabilities_unconditional": "SELECT player_id, round(p_traded_kill * p_kill, 6) AS p_traded_kill, round(p_two_piece * p_kill, 6) AS p_two_piece, round(p_fail_trade * p_death, 6) AS p_fail_trade, round(p_traded_death * p_death, 6) AS p_traded_death FROM probs",
        "expected_engagement_value": f"SELECT player_id, round({exp_eng}, 6) AS exp_eng FROM probs",
        "expected_kills_added": f"SELECT player_id, {_r('exp_eng')}, n, {_r('added', 'time_s', 'kapm')}, round((SELECT avg(kapm) FROM ({kapm})), 6) AS league_kapm FROM ({kapm})",
        "value_per_10min": f"SELECT player_id, round(p_kill, 6) AS kill, round(p_no_trade_att_kill, 6) AS no_trade_attempted_kill, round(p_two_piece, 6) AS two_piece, round(p_trade_att_death, 6) AS trade_attempted_death, round(p_traded_death, 6) AS traded_death, round({value10}, 6) AS eng_value_10 FROM probs LEFT JOIN box_table ON name = player_id",
        "coef_percentiles": coef_ranked,
        "impact_vs_actual": f"SELECT player_id, {recoded.format(c='name')} AS name, value, percentile, avg, false AS actual, {place.format(c='name')} AS ord FROM ({coef_ranked}) WHERE name IN ({impacts}) UNION ALL SELECT player_id, {recoded.format(c='stat')}, value, percentile, NULL, true, {place.format(c='stat')} FROM ({ranked_rates}) WHERE stat IN ({actuals})",
        "box_stats": "SELECT name, stat, round(value, 6) AS value, " + _percentile() + " FROM (" + _gather("box_table", ["name"], ["kd", "time_s", "kpm", "epm"]) + ")",
        "pace_added": "SELECT player_id, round(pm_added_pace, 6) AS pm_added_pace, round(pm_added_pace / games, 6) AS kapr_pace FROM pace LEFT JOIN games USING (player_id)",
        "quality_added": "SELECT player_id, round(pm_added_total, 6) AS pm_added_total, round(pm_added_total / games, 6) AS kapr_quality FROM quality",
        "skill_added": f"SELECT player_id, {_r('pm_added_skill', 'kapr_skill')} FROM skill_pm",
        "player_war": "SELECT player_id, round(pm_added_pace / g.games + pm_added_total / q.games + kapr_skill, 6) AS kapr, round((pm_added_pace + pm_added_total + pm_added_skill) / g.games, 6) AS pm_g, round(pm_added_pace + pm_added_total + pm_added_skill, 6) AS pm_total, round((pm_added_pace + pm_added_total + pm_added_skill) / g.games * 0.18, 6) AS wapr FROM pace LEFT JOIN quality q USING (player_id) LEFT JOIN skill_pm USING (player_id) LEFT JOIN games g USING (player_id)",
        "win_by_differential": "SELECT bin, round(avg(CAST(is_victor AS INTEGER)), 6) AS win_pct, count(*) AS n FROM (SELECT *, CASE WHEN pm > -10 AND pm <= 10 THEN '(' || (pm - 1) || ',' || pm || ']' END AS bin FROM pm_mode) GROUP BY bin",
        "season_stats": f"SELECT year_no, title, mode, player, kills, deaths, rounds, n, {_r('kd')} FROM seasons",
        "season_games": "SELECT year_no, CAST(sum(n) AS BIGINT) AS n FROM seasons GROUP BY year_no",
        "year_over_year_corr": f"SELECT name, round(corr(value, next_year), 6) AS cor FROM ({stat_next}) WHERE value IS NOT NULL AND next_year IS NOT NULL GROUP BY name",
        "first_groups": "SELECT match_id, event_id, time_ms, id, attacker_id FROM seq WHERE match_id IN (SELECT DISTINCT match_id FROM seq ORDER BY match_id LIMIT 5)",
        "one_per_group": "SELECT match_id, event_id, type, player FROM (SELECT *, row_number() OVER (PARTITION BY match_id, event_id ORDER BY h) AS place FROM hashed) WHERE place = 1",
        "train_test_split": "SELECT match_id, event_id, CAST('0x' || substr(md5(match_id || '|' || event_id || '|7'), 1, 8) AS BIGINT) % 1000000 < 750000 AS is_train FROM seq",
        "varying_terms": "SELECT term, n FROM (SELECT player_id || '_' || p AS term, count(DISTINCT match_id || '|' || event_id) AS n FROM roles GROUP BY 1) WHERE n < (SELECT count(*) FROM outcomes WHERE trade_att)",
        "odds_ratio_delta": f"SELECT player_id, round((beta_1 - 1) * (kill_pct / (1 - kill_pct)) / (1 + (beta_1 - 1) * (kill_pct / (1 - kill_pct))), 6) AS delta FROM betas JOIN ({shown_rates}) USING (player_id)",
        "predictions_by_adv": "SELECT win, adv, count(*) AS n, round(avg(pred_win), 6) AS mean_pred, round(avg(CAST(pred_win > 0.5 AS INTEGER)), 6) AS called FROM situations GROUP BY win, adv",
        "match_details": "SELECT i.match_id, i.mode, i.map, i.duration_ms, i.rounds, s.name AS team, s.score, s.is_victor FROM info i JOIN scores s USING (match_id)",
        "predicted_by_state": "SELECT s.state, count(*) AS n, round(avg(c.pred_win), 6) AS mean_pred, round(avg(CAST(c.win AS INTEGER)), 6) AS mean_win FROM situations c JOIN states s ON c.match_id = s.match_id AND c.event_id = s.event_id GROUP BY s.state HAVING count(*) > 100",
        "closed_form_grid": "SELECT pkk_x, pkk_y, tsla_x, tsla_y, round(o / (1 + o), 6) AS pred_win FROM (SELECT *, exp(0.254 * CAST(pkk_x AS INTEGER) + 2.79e-5 * tsla_x - 0.254 * CAST(pkk_y AS INTEGER) - 2.79e-5 * tsla_y - 0.0117 * CAST(pkk_x AND pkk_y AS INTEGER)) AS o FROM (SELECT DISTINCT pkk_x FROM pairs), (SELECT DISTINCT pkk_y FROM pairs), (SELECT unnest(range(0, 5001, 100)) AS tsla_x), (SELECT unnest(range(0, 5001, 1000)) AS tsla_y))",
        "xkill_confusion": 'SELECT win, CAST(sum(CASE WHEN pred_win > 0.5 THEN 0 ELSE 1 END) AS BIGINT) AS "false", CAST(sum(CASE WHEN pred_win > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS "true" FROM scored GROUP BY win',
    }
    bodies |= _designs()
    return {name: f"{chain}\n{body}" for name, body in bodies.items()}


def _designs() -> dict[str, str]:
    """Design matrices in long form: a row for every term that holds in an event."""
    acting = (
        "SELECT a.match_id, a.event_id, coalesce(o.trade_att, false) AS outcome, a.alive, a.player_id,"
        " CASE WHEN a.player_id = a.id THEN 'DEAD' WHEN a.player_id = a.attacker_id THEN 'KILLER'"
        " ELSE a.type END AS role FROM alive a JOIN outcomes o USING (match_id, event_id)"
    )
    return {
        "trade_attempted_design": (
            f"SELECT match_id, event_id, outcome, player_id || '_' || role AS term FROM ({acting})"
            " WHERE alive = 1 AND role <> 'FOR' UNION ALL SELECT match_id, event_id,"
            " coalesce(trade_att, false), 'adv' || adv FROM outcomes JOIN states USING (match_id, event_id)"
        ),
        "trade_won_design": (
            "SELECT DISTINCT match_id, event_id, traded AS outcome, player_id || '_' || p AS term"
            " FROM roles JOIN states USING (match_id, event_id) UNION ALL SELECT DISTINCT match_id,"
            " event_id, traded, 'adv' || adv FROM roles JOIN states USING (match_id, event_id)"
        ),
        "duel_design": (
            "SELECT match_id, event_id, player, win AS outcome, round(pred_win, 6) AS pred_win,"
            " unnest([player || '_ENG', 'adv' || adv]) AS term FROM situations"
            " WHERE adv IS NOT NULL AND trade_sit <> 'NONE'"
        ),
        "triplet_design": (
            "SELECT DISTINCT match_id, event_id, win AS outcome, player || '_' || type AS term"
            " FROM triplets WHERE win IS NOT NULL AND player IS NOT NULL UNION ALL"
            " SELECT DISTINCT match_id, event_id, win, 'state' || state FROM triplets"
            " JOIN states USING (match_id, event_id) WHERE win IS NOT NULL"
        ),
        "pace_design": (
            "SELECT match_id, event_id, model_ms, player_id || '_' || type AS term FROM timed"
            " JOIN alive USING (match_id, event_id) WHERE alive = 1"
            " UNION ALL SELECT match_id, event_id, model_ms, 'state' || state FROM timed"
        ),
        "win_design": "SELECT is_victor, CAST(pm AS DOUBLE) AS adv FROM pm_mode WHERE is_victor IS NOT NULL",
    }
