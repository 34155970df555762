"""Limits of the quality gate, read from JSON and checked when loaded."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

# Columns whose fill rate is measured; a limit on any other column would never fire.
MEASURED = ["description", "hackathon_date", "repo_url", "demo_url", "prize_track"]
_LIMIT_KEY = {"absolute": "max_delta_points", "relative": "max_pct"}


@dataclass(frozen=True)
class Limit:
    """Largest tolerated drop of a metric, in points or in percent of the baseline."""

    metric: str
    mode: str
    limit: float


@dataclass(frozen=True)
class Thresholds:
    profiles: dict[str, list[Limit]]
    url_valid_min_rate: float


def _positive(where: str, block: dict, key: str) -> float:
    value = block.get(key)
    if isinstance(value, bool) or not isinstance(value, int | float) or value <= 0:
        raise ValueError(f"{where}.{key} must be a positive number, got {value!r}")
    return float(value)


def _column_limit(profile: str, column: str, rule: object) -> Limit:
    where = f"{profile}.null_rate.{column}"
    if column not in MEASURED:
        raise ValueError(f"{where}: not a measured column ({', '.join(MEASURED)})")
    if not isinstance(rule, dict) or rule.get("mode") not in _LIMIT_KEY:
        raise ValueError(f"{where}: mode must be one of {', '.join(_LIMIT_KEY)}")
    return Limit(f"null_rate.{column}", rule["mode"], _positive(where, rule, _LIMIT_KEY[rule["mode"]]))


def _profile(name: str, block: object) -> list[Limit]:
    rates = block.get("null_rate") if isinstance(block, dict) else None
    if not isinstance(rates, dict) or not rates:
        raise ValueError(f"{name}.null_rate is missing or empty")
    return [_column_limit(name, column, rule) for column, rule in rates.items()] + [
        Limit("median_desc_len", "relative", _positive(name, block, "median_desc_len_max_pct")),
        Limit("projects_per_hackathon", "overlap", _positive(name, block, "projects_per_hackathon_max_pct")),
        Limit("placement_fill", "absolute", _positive(name, block, "placement_fill_max_delta_points")),
    ]


def parse_thresholds(data: object) -> Thresholds:
    if not isinstance(data, dict):
        raise ValueError("thresholds must be a mapping")
    for key in ("moving", "anchor", "url_valid_min_rate"):
        if key not in data:
            raise ValueError(f"{key} is missing")
    rate = _positive("thresholds", data, "url_valid_min_rate")
    if rate > 1:
        raise ValueError(f"url_valid_min_rate must be at most 1, got {rate}")
    return Thresholds({name: _profile(name, data[name]) for name in ("moving", "anchor")}, rate)


def load_thresholds(path: str | Path = Path(__file__).with_name("thresholds.json")) -> Thresholds:
    return parse_thresholds(json.loads(Path(path).read_text(encoding="utf-8")))
