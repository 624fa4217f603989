"""Settings: YAML with ${VAR} substitution, dotted-path writes, parameter grids."""

from __future__ import annotations

import copy
import itertools
import os
import re
from typing import Any

# Default parameters.
DEFAULTS: dict[str, Any] = {
    "risk": {"risk_pct": 0.01, "min_rr": 2.5, "daily_halt": 0.04, "weekly_halt": 0.08, "max_positions": 3, "trail_mult": 1.0, "trail_activate_r": 1.5, "conviction_min": 0.5, "conviction_max": 1.0, "blackout_minutes": 15},
    "clusters": [["BTC/USDT", "ETH/USDT", "SOL/USDT"], ["SPY", "QQQ", "IWM"], ["EUR_USD", "GBP_USD"]],
    "class_caps": {"crypto": 2, "equity": 2, "forex": 2, "commodity": 1},
    "momentum": {"ema_fast": 9, "ema_slow": 21, "rsi_period": 14, "rsi_min_long": 50.0, "rsi_max_short": 50.0, "volume_mult": 1.5, "htf_ema": 50, "stop_atr": 1.75, "reward": 3.0},
    "mean_reversion": {"bb_period": 20, "bb_std": 2.0, "rsi_period": 14, "oversold": 25.0, "overbought": 75.0, "squeeze_pct": 0.02, "squeeze_on": False, "stop_atr": 1.5, "fallback_r": 2.5},
    "breakout": {"lookback": 20, "volume_mult": 1.5, "consolidation_pct": 0.5, "htf_ema": 50, "stop_atr": 1.5, "pad_atr": 0.5, "reward": 3.0},
    "regime": {"adx_period": 14, "adx_trend": 25.0, "adx_range": 20.0, "atr_period": 14, "atr_high_vol_pct": 2.0},
    "enabled": ["momentum", "mean_reversion", "breakout"],
    "backtest": {"equity": 100_000.0, "warmup": 200, "fee_bps": 5.0, "slippage_bps": 5.0, "min_htf": 60},
    "execution": {"limit_offset_bps": 2.0, "timeout_s": 30, "fallback": ["momentum", "breakout"], "paper_slippage_bps": 3.0, "paper_fee_bps": 5.0},
    "ml": {"lookback": 50, "min_score": 0.55, "horizon": 20, "min_rows": 100},
}


def with_settings(**changes: Any) -> dict[str, Any]:
    """The defaults with dotted-path changes (`a__b=1` or {"a.b": 1} through set_path)."""
    c = copy.deepcopy(DEFAULTS)
    for k, v in changes.items():
        if k in c:
            c[k] = v
        else:
            set_path(c, k.replace("__", "."), v)
    return c


def set_path(config: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """Write one dotted key; a bare key belongs to the momentum strategy."""
    parts = path.split(".") if "." in path else ["momentum", path]
    node = config
    for p in parts[:-1]:
        node = node.setdefault(p, {})
    node[parts[-1]] = value
    return config


PERIODS = [("momentum", "ema_fast"), ("momentum", "ema_slow"), ("momentum", "rsi_period"), ("momentum", "htf_ema"), ("mean_reversion", "bb_period"), ("mean_reversion", "rsi_period"), ("breakout", "lookback"), ("regime", "adx_period"), ("regime", "atr_period")]


def faults(config: dict[str, Any]) -> str | None:
    """What makes the settings of strategies unusable: a period that is no whole number above 0, a limit that is no number."""
    for section, key in PERIODS:
        v = config[section].get(key)
        if not isinstance(v, int) or isinstance(v, bool) or v < 1:
            return f"{section}.{key} must be a whole number above 0: {v!r}"
    for section in ("momentum", "mean_reversion", "breakout", "regime", "risk", "backtest"):
        for key, v in config[section].items():
            if not isinstance(v, (int, float)):
                return f"{section}.{key} must be a number: {v!r}"
    return None


def substitute_env(value: Any, env: dict[str, str] | None = None) -> Any:
    """Replace ${VAR} (capitals, digits and _) in all strings of nested mappings and lists; an unset variable is empty."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: substitute_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute_env(v, env) for v in value]
    return re.sub(r"\$\{([A-Z_][A-Z0-9_]*)\}", lambda m: env.get(m[1], ""), value) if isinstance(value, str) else value


def load_config(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML settings needs the yaml package") from e
    with open(path) as f:
        return substitute_env(yaml.safe_load(f))


def expand_grid(grid: dict[str, list]) -> list[dict[str, Any]]:
    """All combinations of a parameter grid, in key order."""
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
