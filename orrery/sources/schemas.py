"""Schemas of the stored tables."""

OHLCV = "date date, open double, high double, low double, close double, volume double"
BARS = f"symbol string, {OHLCV}, market_cap double"
#: Columns of bar files as they come: dates may carry a time and an offset.
BAR_FILE = "Date string, Open double, High double, Low double, Close double, Volume double, marketCap double"
BATCH_FILE = "Date string, Symbol string, Open double, High double, Low double, Close double, Volume double"
INDUSTRIES = "sector_key string, sector_name string, industry_key string, industry_name string, symbol string, market_weight double"
MEMBERSHIP = "symbol string, industry_key string, marketCap double"
UNIVERSE = "ticker string, group_name string, market_cap double"
