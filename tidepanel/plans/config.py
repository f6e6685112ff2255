"""Configuration: defaults, deep merge, checks and a signature."""

from __future__ import annotations

import hashlib
import json
from copy import deepcopy

DEFAULTS = {
    "project": {"seed": 2026, "run_name": "run"},
    "data": {"timezone": "Europe/Zurich", "short_gap_steps": 1, "weather_scenario": "operational"},
    "inclusion": {"min_days": 180, "max_target_missing_fraction": 0.1, "min_heating_seasons": 1, "heating_months": [10, 11, 12, 1, 2, 3, 4], "min_season_days": 120, "min_weather_match_fraction": 0.9},
    "features": {"lag_steps": [1, 4, 24, 96, 672], "rolling_steps": [4, 12, 24, 48, 96], "history_steps": 672, "forecast_steps": 96, "on_threshold": 0.05},
    "split": {"unseen_household_fraction": 0.2, "validation_household_fraction": 0.1, "temporal_train_fraction": 0.7, "temporal_calibration_fraction": 0.15, "rolling_folds": 3},
    "sampling": {"eval_clock_hours": [0, 6, 12, 18], "max_eval_origins_per_household": 120, "train_stride": 4, "max_train_rows": 500000, "rolling_monitor_fraction": 0.1},
    "models": {"elastic_net": {"alpha": 0.001, "l1_ratio": 0.2}, "boosted_trees": {"iterations": 20, "depth": 5}},
    "evaluation": {"alpha": 0.2, "conformal_min_samples": 100, "report_horizons": [1, 4, 24, 96], "cold_temperature_quantile": 0.05, "peak_threshold_quantile": 0.95, "top_peak_fraction": 0.05, "mase_season_steps": 96, "mase_min_differences": 96},
    "statistics": {"bootstrap_repetitions": 10000, "multiple_testing_alpha": 0.05, "minimum_households_for_confirmatory": 20, "portfolio_sensitivity_thresholds": [20, 30, 50], "comparisons": [["boosted_trees", "persistence"], ["boosted_trees", "daily"], ["boosted_trees", "weekly"], ["boosted_trees", "elastic_net"]]},
    "portfolio": {"sizes": [4, 5, 10, 25], "types": ["ASHP", "GSHP", "mixed"], "repetitions": 20, "coverage": 0.9, "min_calibration_samples": 100, "destination_capacity_factor": 1.0, "peak_threshold_quantiles": [0.9, 0.95, 0.99], "flexible_fractions": [0.05, 0.1, 0.15, 0.2], "shift_hours": [1, 2, 3]},
}


class ConfigError(ValueError):
    """A setting is missing or out of range."""


def merged(overrides: dict, base: dict | None = None) -> dict:
    """``base`` (the defaults) with ``overrides``; mappings merge, anything else is replaced."""
    out = deepcopy(DEFAULTS if base is None else base)
    for k, v in overrides.items():
        out[k] = merged(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def checked(config: dict) -> dict:
    """``config``; raises on the first setting out of range."""
    s, f, e, p, i, t = (config[k] for k in ("split", "features", "evaluation", "portfolio", "inclusion", "statistics"))
    rules = {
        "alpha must lie between 0 and 1": 0 < e["alpha"] < 1,
        "split fractions must lie between 0 and 1": all(0 <= v < 1 for k, v in s.items() if k.endswith("fraction")),
        "shares of the inclusion must lie between 0 and 1": all(0 <= v <= 1 for k, v in i.items() if k.endswith("fraction")),
        "heating months must be months": all(1 <= m <= 12 for m in i["heating_months"]),
        "least days and seasons can't be negative": min(i["min_days"], i["min_heating_seasons"], i["min_season_days"]) >= 0,
        "rolling folds, repetitions and row caps must be positive": min(s["rolling_folds"], t["bootstrap_repetitions"], config["sampling"]["max_train_rows"]) > 0,
        "the monitored share must lie between 0 and 1": 0 < config["sampling"]["rolling_monitor_fraction"] < 1,
        "quantiles and significance must lie between 0 and 1": all(0 < q < 1 for q in (e["cold_temperature_quantile"], e["peak_threshold_quantile"], e["top_peak_fraction"], t["multiple_testing_alpha"], *p["peak_threshold_quantiles"])),
        "comparisons are pairs of different models": all(len(c) == 2 and c[0] != c[1] for c in t["comparisons"]),
        "portfolio types are known": set(p["types"]) <= {"ASHP", "GSHP", "mixed"},
        "shift hours and the destination's capacity must be positive": min([*p["shift_hours"], p["destination_capacity_factor"]]) > 0,
        "models' iterations and depth must be positive": min(config["models"]["boosted_trees"].values()) > 0,
        "training and calibration must leave time for tests": s["temporal_train_fraction"] + s["temporal_calibration_fraction"] < 1,
        "held-out households must leave some for training": s["unseen_household_fraction"] + s["validation_household_fraction"] < 1,
        "steps must be positive": min([f["history_steps"], f["forecast_steps"], *f["lag_steps"], *f["rolling_steps"]]) > 0,
        "lags must fit into the history": max(f["lag_steps"]) <= f["history_steps"],
        "report horizons must lie on the forecast path": all(1 <= h <= f["forecast_steps"] for h in e["report_horizons"]),
        "clock hours must be hours": all(0 <= h < 24 for h in config["sampling"]["eval_clock_hours"]),
        "the weather scenario is operational or oracle": config["data"]["weather_scenario"] in ("operational", "oracle"),
        "coverage must lie in (0, 1]": 0 < p["coverage"] <= 1,
        "flexible fractions must lie in [0, 1]": all(0 <= x <= 1 for x in p["flexible_fractions"]),
        "portfolio sizes and repetitions must be positive": min([*p["sizes"], p["repetitions"]]) > 0,
    }
    for message, holds in rules.items():
        if not holds:
            raise ConfigError(message)
    return config


def signature(config: dict) -> str:
    """sha256 of the canonical JSON: equal settings, equal signature."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
