"""Row types of the engine; prices and quantities are doubles, missing values are NULL."""

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
SIGNAL = "symbol string, asset_class string, side string, strategy string, entry double, stop double, take_profit double, conviction double, ts timestamp_ntz, timeframe string, regime string, ml_score double, metadata map<string,double>"
TRADE = "run_id string, symbol string, asset_class string, side string, strategy string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, qty double, pnl double, pnl_pct double, r_multiple double, exit_reason string, fees double, slippage double, seq long"
EVENT = "kind string, run_id string, symbol string, ts timestamp_ntz, side string, strategy string, entry_time timestamp_ntz, entry_price double, exit_price double, qty double, pnl double, pnl_pct double, r_multiple double, reason string, fees double, equity double, seq long"
ORDER = "order_id long, symbol string, side string, qty double, type string, limit_price double, stop_price double, status string, filled_qty double, avg_fill_price double, strategy string"
REQUIRED = ("open", "high", "low", "close", "volume")
