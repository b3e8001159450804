from .scalars import (
    clip_gap,
    interval_label,
    odds_to_probability,
    odds_ratio_delta,
    per_minute,
    recode,
    snake_case,
    term_parts,
    utc_seconds,
)

__all__ = [
    "clip_gap",
    "interval_label",
    "odds_to_probability",
    "odds_ratio_delta",
    "per_minute",
    "recode",
    "snake_case",
    "term_parts",
    "utc_seconds",
]
