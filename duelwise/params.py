"""Default values of the analysis. Every operator takes them as keyword arguments."""

# What the feed is filtered to.
EVENT_TYPE = "death"
MODE = "Hardpoint"

# Times in milliseconds.
RESPAWN_MS = 4000
TRADE_MS = 5000
LONG_TRADE_MS = 15000
PDK_MS = 5000
GAP_CAP_MS = 15000
XKILL_GAP_CAP_MS = 30000

# Thresholds (all comparisons are strict).
MIN_GAMES = 100
MIN_RATE_N = 200
MIN_TIME_S = 6000
MIN_SITUATIONS = 500
MIN_STATE_N = 100
MIN_SEASON_GAMES = 20

# Closed-form duel model (streak, gap in ms, both on a streak).
XKILL_STREAK = 0.254
XKILL_GAP = 2.79e-5
XKILL_BOTH = -0.0117

# Offsets that turn player coefficients into odds.
SKILL_INTERCEPT = -3.88
SKILL_SLOPE = 7.64
SKILL_AT = 0.5
TRADE_BASE = 0.909
TRADE_ADV = 1.13
TRADE_OTHER_KILLER = 0.828
TRADE_OTHER_DEAD = 1.4
WON_BASE = 1.68
WON_OTHER_P1 = 1.17
WON_OTHER_P2 = 0.91
WON_ADV = 1.01

# Rating composition.
BASE_WIN = 0.5
WINS_PER_KILL = 0.18
START_STATE = "4v4"
BIN_LOW = -10
BIN_HIGH = 10

# Seasons, as (first day after the season, title, number).
SEASONS = (
    ("2017-10-01", "IW", 1),
    ("2018-10-01", "WWII", 2),
    ("2019-10-01", "BO4", 3),
)
