"""SQL of the registered queries, put together from named parts.

A text is a WITH clause of the parts that it needs, in the order below, and a final SELECT.
"""

from __future__ import annotations

import re

# Fixed values, written out here as well: the texts check the library, so they take nothing from it.
QUADRANT_SCORE = {"Leading": 100, "Improving": 67, "Weakening": 33, "Lagging": 0}
TAIL_SCORE = {"right-up": 100, "right-down": 50, "left-up": 50, "left-down": 0, "unknown": 50}
TIMEFRAME_LABEL = {
    ("Leading", "Leading"): "Both Leading",
    ("Improving", "Leading"): "Weekly Imp / Mo Leading",
    ("Leading", "Improving"): "Weekly Lead / Mo Imp",
    ("Improving", "Improving"): "Both Improving",
    ("Weakening", "Leading"): "Pullback (Mo Leading)",
    ("Lagging", "Leading"): "Deep Pullback (Mo Lead)",
    ("Weakening", "Improving"): "Weekly Weak / Mo Imp",
    ("Lagging", "Improving"): "Weekly Lag / Mo Imp",
    ("Leading", "Weakening"): "Weekly Lead / Mo Weak",
    ("Improving", "Weakening"): "Weekly Imp / Mo Weak",
    ("Weakening", "Weakening"): "Both Weakening",
    ("Lagging", "Weakening"): "Both Bearish",
    ("Leading", "Lagging"): "Weekly Lead / Mo Lag",
    ("Improving", "Lagging"): "Weekly Imp / Mo Lag",
    ("Weakening", "Lagging"): "Both Bearish",
    ("Lagging", "Lagging"): "Both Lagging",
}
TIMEFRAME_SCORE = {
    "Both Leading": 100,
    "Weekly Imp / Mo Leading": 85,
    "Weekly Lead / Mo Imp": 80,
    "Both Improving": 75,
    "Pullback (Mo Leading)": 60,
    "Deep Pullback (Mo Lead)": 50,
    "Weekly Weak / Mo Imp": 45,
    "Weekly Lag / Mo Imp": 40,
    "Weekly Lead / Mo Weak": 35,
    "Weekly Imp / Mo Weak": 30,
    "Both Weakening": 25,
    "Both Bearish": 10,
    "Weekly Lead / Mo Lag": 30,
    "Weekly Imp / Mo Lag": 25,
    "Both Lagging": 0,
}
# Order of the labels, from weakest to strongest.
SEVERITY_ORDER = ("Confirmed Exit", "Weakening", "Neutral / Watch", "Pullback in Uptrend", "Early Signal", "Confirmed", "Confirmed + ATH", "Strong Confirmed", "Strong Confirmed + ATH", "Both TF Confirmed", "Both TF Confirmed + ATH")

PARTS: dict[str, str] = {}
FINAL: dict[str, str] = {}


def r(x: str, digits: int) -> str:
    """Half-even rounding."""
    return f"round_even(({x}) * 1e{digits}, 0) / 1e{digits}"


def pct(new: str, old: str) -> str:
    return f"((({new}) / nullif({old}, 0)) - 1) * 100"


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


# -- bars ------------------------------------------------------------------------------------------------------------

part("trades", """SELECT CAST(l_suppkey AS VARCHAR) AS stock, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS qty, 90 + (CAST(round(l_extendedprice * 100) AS BIGINT) % 2000) / 100.0::DOUBLE AS px,
  CAST(l_orderkey AS BIGINT) * 100000000000 + CAST(l_partkey AS BIGINT) * 100000 + CAST(l_linenumber AS BIGINT) * 1000 + CAST(l_quantity AS BIGINT) AS ord FROM lineitem""")
OHLC = "arg_min(px, ord) AS open, max(px) AS high, min(px) AS low, arg_max(px, ord) AS close, sum(qty) AS volume"
RESAMPLED = "arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume"
WEEK = "CAST(date_trunc('week', date) AS DATE)"
part("all_bars", f"SELECT stock AS symbol, date, {OHLC} FROM trades GROUP BY ALL")
part("bars", "SELECT * FROM all_bars WHERE isodow(date) < 6")
part("months", f"SELECT symbol, last_day(date) AS d, {RESAMPLED} FROM all_bars GROUP BY ALL")
part("weeks", f"SELECT symbol, {WEEK} AS d, {RESAMPLED} FROM all_bars GROUP BY ALL")
part("month_bars", "SELECT symbol, d AS date, open, high, low, close, volume FROM months")
part("week_bars", "SELECT symbol, d AS date, open, high, low, close, volume FROM weeks")
part("spy_all", "SELECT date, CAST(sum(CAST(round(px * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS close, min(px) AS low, max(px) AS high, sum(qty) AS volume, 'SPY' AS symbol FROM trades GROUP BY date")
part("spy", "SELECT * FROM spy_all WHERE isodow(date) < 6")
part("spy_week", f"SELECT {WEEK} AS d, arg_max(close, date) AS close FROM spy_all GROUP BY ALL")
part("spy_month", "SELECT last_day(date) AS d, arg_max(close, date) AS close FROM spy_all GROUP BY ALL")
part("spy_weeks", "SELECT d AS date, close FROM spy_week")
part("spy_months", "SELECT d AS date, close FROM spy_month")
part("caps", "SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 2))), 0) AS DOUBLE) AS market_cap FROM lineitem GROUP BY ALL")
part("universe", "SELECT symbol AS ticker, CASE WHEN market_cap >= 32.4e6 THEN 'large' WHEN market_cap >= 31.3e6 THEN 'mid' ELSE 'small' END AS group_name, market_cap FROM caps WHERE market_cap >= 28e6")
part("dim", "SELECT CAST(r_regionkey AS VARCHAR) AS sector_key, r_name AS sector_name, CAST(n_nationkey AS VARCHAR) AS industry_key, n_name AS industry_name, '^YH' || CAST(n_nationkey AS VARCHAR) AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey")
part("members", "SELECT CAST(s_suppkey AS VARCHAR) AS symbol, CAST(s_nationkey AS VARCHAR) AS industry_key, market_cap FROM supplier LEFT JOIN caps ON caps.symbol = CAST(s_suppkey AS VARCHAR)")
part("published", f"SELECT '^YH' || industry_key AS symbol, date, {OHLC} FROM trades JOIN members ON stock = members.symbol WHERE isodow(date) < 6 GROUP BY ALL")
part("sector_bars", f"SELECT 'R' || sector_key AS symbol, date, {OHLC} FROM trades JOIN members ON stock = members.symbol JOIN dim USING (industry_key) WHERE isodow(date) < 6 GROUP BY ALL")
part("clock_bars", "SELECT symbol, date, close AS open, high, low, close, volume FROM spy UNION ALL SELECT symbol, date, open, high, low, close, volume FROM sector_bars")
part("snap_days", f"SELECT max(date) AS date FROM bars GROUP BY {WEEK}")

BAR = "symbol, date, open, high, low, close, volume"
FINAL |= {
    "stock_bars": f"SELECT {BAR} FROM all_bars",
    "weekday_bars": f"SELECT {BAR} FROM bars",
    "monthly_bars": f"SELECT {BAR} FROM month_bars",
    "weekly_bars": f"SELECT {BAR} FROM week_bars",
    "merged_months": f"SELECT symbol, last_day(date) AS date, {RESAMPLED} FROM all_bars WHERE last_day(date) <> '1997-06-30' OR date >= '1997-06-10' GROUP BY symbol, last_day(date) UNION ALL SELECT symbol, last_day(date), {RESAMPLED} FROM all_bars WHERE last_day(date) = '1997-06-30' AND date < '1997-06-15' AND symbol NOT IN (SELECT symbol FROM all_bars WHERE date BETWEEN '1997-06-10' AND '1997-06-30') GROUP BY symbol, last_day(date)",
    "benchmark_bars": f"SELECT date, {r('close', 6)} AS close, {r('low', 6)} AS low, {r('high', 6)} AS high, volume, symbol FROM spy_all",
    "market_caps": "SELECT * FROM caps",
    "universe_buckets": "SELECT * FROM universe",
    "universe_summary": "SELECT group_name, count(*) AS n FROM universe GROUP BY ALL",
    "index_symbols": "SELECT DISTINCT symbol FROM published",
    "stitched_bars": f"SELECT {BAR} FROM all_bars WHERE date < '1997-01-01' UNION ALL SELECT {BAR} FROM all_bars JOIN (SELECT symbol, max(date) AS last FROM all_bars WHERE date < '1997-01-01' GROUP BY symbol) USING (symbol) WHERE date > last AND date >= '1996-06-01'",
    "ingested_bars": f"""SELECT {BAR} FROM (SELECT a.*, last, (SELECT max(date) FROM all_bars WHERE date <= '1997-06-30' AND NOT ends_with(symbol, '3')) AS seen FROM all_bars a JOIN (SELECT symbol, max(date) AS last FROM all_bars WHERE date < '1997-01-01' AND NOT (ends_with(symbol, '3') AND date >= '1996-03-01') GROUP BY symbol) USING (symbol))
      WHERE date <= last OR (date > last AND date >= '1996-06-01' AND (NOT ends_with(symbol, '3') OR date > seen - 10))""",
    "stitched_spellings": f"""SELECT CASE WHEN CAST(symbol AS INTEGER) % 3 = 1 THEN 'K-' ELSE 'K.' END || symbol AS symbol, date, open, high, low, close, volume FROM (SELECT {BAR}, max(date) FILTER (date < '1997-01-01') OVER (PARTITION BY symbol) AS last FROM all_bars)
      WHERE date <= last OR date > last AND date >= '1996-06-01'""",
    "universe_by_source": "SELECT * FROM universe",
    "universe_table": "SELECT * FROM universe WHERE group_name IN ('large', 'mid')",
    "history_cutoff": "SELECT max(date) AS cutoff FROM all_bars WHERE symbol = coalesce((SELECT any_value(symbol) FROM all_bars WHERE symbol = '7'), (SELECT any_value(symbol) FROM all_bars WHERE symbol = '3'), '1')",
    "snapshot_dates": f"SELECT max(date) AS date FROM bars WHERE date >= '1995-01-01' GROUP BY {WEEK}",
    "filled_closes": """SELECT symbol, date, close FROM (SELECT m.symbol, g.date, last_value(b.close IGNORE NULLS) OVER (PARTITION BY m.symbol ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close
      FROM (SELECT DISTINCT industry_key, date FROM bars JOIN members USING (symbol)) g JOIN members m USING (industry_key) LEFT JOIN bars b ON b.symbol = m.symbol AND b.date = g.date) WHERE close IS NOT NULL""",
    "as_of_closes": "SELECT s.symbol, d.date, CASE WHEN b.date >= d.date - 5 THEN b.close END AS close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN snap_days d ASOF LEFT JOIN bars b ON b.symbol = s.symbol AND d.date >= b.date",
    "aligned_strength": f"SELECT b.symbol, date, {r('(b.close / first_value(b.close) OVER w) / (s.close / first_value(s.close) OVER w)', 6)} AS strength FROM bars b JOIN spy s USING (date) WINDOW w AS (PARTITION BY b.symbol ORDER BY date)",
    "bars_round_trip": f"SELECT {BAR} FROM bars",
}


def sma(x: str, n: int, by: str) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN avg({x}) {w} END"


def zscore(x: str, n: int, by: str) -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} AND stddev_pop({x}) {w} > 1e-12 THEN 100 + ({x} - avg({x}) {w}) / stddev_pop({x}) {w} END"


def share(x: str, keys: str = "") -> str:
    """Average rank over the count of non-null values."""
    first = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys}" if keys else ""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {first}({x}) IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {first}{x}) - 1) / 2.0::DOUBLE) / count({x}) OVER ({over}) END"


def sctr(x: str, keys: str = "") -> str:
    return r(f"({share(x, keys)}) * 99.9::DOUBLE", 1)


def ibd(x: str, keys: str = "") -> str:
    return f"CAST(round_even(({share(x, keys)}) * 98 + 1, 0) AS INTEGER)"


def ppo(closes: str) -> str:
    """Three-day slope of the PPO histogram at the end of a list."""
    f, s = "((1 - 2.0::DOUBLE / 13) * a.f + (2.0::DOUBLE / 13) * b.f)", "((1 - 2.0::DOUBLE / 27) * a.s + (2.0::DOUBLE / 27) * b.s)"
    p = f"(({f} - {s}) / {s} * 100)"
    g = f"((1 - 0.2::DOUBLE) * a.g + 0.2::DOUBLE * {p})"
    start = "{'f': x, 's': x, 'g': 0.0::DOUBLE, 'h0': 0.0::DOUBLE, 'h1': NULL::DOUBLE, 'h2': NULL::DOUBLE, 'h3': NULL::DOUBLE}"
    step = f"{{'f': {f}, 's': {s}, 'g': {g}, 'h0': {p} - {g}, 'h1': a.h0, 'h2': a.h1, 'h3': a.h2}}"
    fold = f"list_reduce(list_transform({closes}, lambda x: {start}), lambda a, b: {step})"
    return f"CASE WHEN len({closes}) < 35 THEN 0.0 ELSE (SELECT greatest(-50.0, least(50.0, (z.h0 - z.h3) / 3)) FROM (SELECT {fold} AS z)) END"


W = "OVER (PARTITION BY symbol ORDER BY date"
FINAL |= {
    "moving_averages": f"SELECT symbol, date, {', '.join(f'{r(sma("close", n, "symbol"), 6)} AS sma{n}' for n in (50, 150, 200))}, {r(pct('close', f'lag(close, 63) {W})'), 6)} AS roc63 FROM bars",
    "year_range": f"""SELECT symbol, date, high_52w, low_52w, high_25, {r('CASE WHEN high_52w > low_52w THEN (close - low_52w) / (high_52w - low_52w) * 100 ELSE 50.0 END', 6)} AS range_pos, {r(pct('close', 'peak'), 6)} AS drawdown FROM (SELECT symbol, date, close,
      max(close) {W} ROWS 251 PRECEDING) AS high_52w, min(close) {W} ROWS 251 PRECEDING) AS low_52w, max(close) {W} ROWS UNBOUNDED PRECEDING) AS peak, max(close) {W} ROWS 24 PRECEDING) AS high_25 FROM bars)""",
    "ppo_slopes": f"SELECT symbol, n, {r(ppo('cs'), 6)} AS ppo_slope FROM (SELECT symbol, count(*) AS n, list(close ORDER BY date) AS cs FROM bars GROUP BY symbol)",
    "closing_ranges": f"SELECT symbol, date, {r('(close - low) / nullif(high - low, 0) * 100', 6)} AS closing_range FROM clock_bars",
    "volume_change": f"SELECT symbol, date, {r(pct('close', f'lag(close) {W})'), 6)} AS pct_chg, {r(f'volume / nullif(lag(volume) {W}), 0)', 6)} AS vol_ratio FROM clock_bars",
    "up_runs": f"""SELECT symbol, date, n - coalesce(max(CASE WHEN NOT coalesce(up, false) THEN n END) {W} ROWS UNBOUNDED PRECEDING), 0) AS run FROM (SELECT symbol, date, close > lag(close) {W}) AS up, row_number() {W}) AS n FROM bars)""",
    "volume_ranks": f"""SELECT symbol, date, year, volume, {ibd('volume')} AS pct, {sctr('volume', 'year')} AS sctr_in_year, CAST(rank() OVER (ORDER BY volume DESC) AS INTEGER) AS rank,
      CAST(row_number() OVER (PARTITION BY year ORDER BY volume DESC, symbol, date) AS INTEGER) AS place_in_year FROM (SELECT symbol, date, CAST(year(date) AS INTEGER) AS year, volume FROM bars)""",
    "rank_scales": f"SELECT symbol, {sctr('cap', 'industry_key')} AS sctr, {ibd('cap', 'industry_key')} AS pct, rank() OVER (PARTITION BY industry_key ORDER BY cap DESC) AS rank FROM (SELECT symbol, industry_key, CAST(floor(market_cap / 1e6) AS BIGINT) AS cap FROM members)",
}


# -- indexes ---------------------------------------------------------------------------------------------------------


def index_parts(name: str, bars: str, fill: int, min_rows: int) -> None:
    part(f"{name}_held", f"SELECT symbol FROM {bars} WHERE close IS NOT NULL GROUP BY symbol HAVING count(*) >= {min_rows}")
    part(f"{name}_w", f"SELECT industry_key, symbol, CASE WHEN sum(cap) OVER p = 0 THEN 1.0::DOUBLE / count(*) OVER p ELSE cap / sum(cap) OVER p END AS weight, count(*) OVER p AS members FROM (SELECT industry_key, symbol, CASE WHEN market_cap > 0 THEN market_cap ELSE 0 END AS cap FROM members JOIN {name}_held USING (symbol)) WINDOW p AS (PARTITION BY industry_key) QUALIFY count(*) OVER p >= 3")
    part(f"{name}_f", f"SELECT w.industry_key, w.symbol, g.date, w.weight, last_value(b.close IGNORE NULLS) OVER (PARTITION BY w.industry_key, w.symbol ORDER BY g.date ROWS BETWEEN {fill} PRECEDING AND CURRENT ROW) AS close FROM {name}_w w JOIN (SELECT DISTINCT industry_key, date FROM {bars} JOIN {name}_w USING (symbol)) g USING (industry_key) LEFT JOIN {bars} b ON b.symbol = w.symbol AND b.date = g.date")
    part(f"{name}_r", f"SELECT industry_key, date, coalesce(sum(weight * ret), 0) AS ret, count(ret) AS n, count(*) AS members FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY industry_key, symbol ORDER BY date), 0) - 1 AS ret FROM {name}_f) GROUP BY industry_key, date")
    part(name, f"SELECT industry_key, date, 1000.0::DOUBLE * product(1 + ret) OVER (PARTITION BY industry_key ORDER BY date ROWS UNBOUNDED PRECEDING) AS close, CAST(members AS INTEGER) AS members FROM {name}_r QUALIFY sum(n) OVER (PARTITION BY industry_key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) > 0")


index_parts("idx", "bars", 5, 100)
index_parts("idxw", "week_bars", 2, 60)
index_parts("idxm", "month_bars", 2, 24)
part("idx1_held", "SELECT DISTINCT symbol FROM bars")
FINAL |= {
    "constituent_weights": f"SELECT industry_key, symbol, {r('weight', 9)} AS weight, members FROM (SELECT industry_key, symbol, CASE WHEN sum(cap) OVER p = 0 THEN 1.0::DOUBLE / count(*) OVER p ELSE cap / sum(cap) OVER p END AS weight, count(*) OVER p AS members FROM (SELECT industry_key, symbol, CASE WHEN market_cap > 0 THEN market_cap ELSE 0 END AS cap FROM members JOIN idx1_held USING (symbol)) WINDOW p AS (PARTITION BY industry_key)) WHERE members >= 3",
    "synthetic_daily": f"SELECT industry_key, date, {r('close', 4)} AS close, members FROM idx",
    "synthetic_weekly": f"SELECT industry_key, date, {r('close', 4)} AS close, members FROM idxw",
    "synthetic_monthly": f"SELECT industry_key, date, {r('close', 4)} AS close, members FROM idxm",
    "zscores": f"SELECT industry_key, date, {r(zscore('close', 10, 'industry_key'), 6)} AS z FROM idx",
}

# -- scores ----------------------------------------------------------------------------------------------------------

COMPONENTS = ("c1_14m_roc", "c2_sma200_pct", "c3_9m_roc", "c4_sma50_pct", "c5_3m_roc", "c6_ppo_slope")
WEIGHTED = "c1_14m_roc * 0.30::DOUBLE + c2_sma200_pct * 0.15::DOUBLE + c3_9m_roc * 0.15::DOUBLE + c4_sma50_pct * 0.15::DOUBLE + c5_3m_roc * 0.10::DOUBLE + c6_ppo_slope * 0.15::DOUBLE"


def score_parts(name: str, series: str, key: str) -> None:
    part(f"{name}_m", f"SELECT {key}, last_day(date) AS d, arg_max(close, date) AS close FROM {series} GROUP BY ALL")
    rocs = ", ".join(f"{pct('close', f'lag(close, {n}) OVER w')} AS {c}" for c, n in (("c1_14m_roc", 14), ("c3_9m_roc", 9), ("c5_3m_roc", 3)))
    part(f"{name}_roc", f"SELECT {key}, {rocs}, count(*) OVER (PARTITION BY {key}) AS months, d FROM {name}_m WINDOW w AS (PARTITION BY {key} ORDER BY d) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY d DESC) = 1")
    part(f"{name}_last", f"SELECT {key}, count(*) AS n, max(date) AS date, arg_max(close, date) AS close, avg(close) FILTER (i <= 50) AS s50, avg(close) FILTER (i <= 200) AS s200, list(close ORDER BY date) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date DESC) AS i FROM {series}) GROUP BY {key} HAVING count(*) >= 210")
    part(f"{name}_c", f"SELECT {key}, date, c1_14m_roc, {pct('close', 's200')} AS c2_sma200_pct, c3_9m_roc, {pct('close', 's50')} AS c4_sma50_pct, c5_3m_roc, {ppo('cs')} AS c6_ppo_slope FROM {name}_last JOIN {name}_roc USING ({key}) WHERE months >= 15")
    part(name, f"SELECT {key}, date, {', '.join(f'{r(c, 4)} AS {c}' for c in COMPONENTS)}, {r(WEIGHTED, 4)} AS raw_score FROM {name}_c WHERE c1_14m_roc IS NOT NULL AND c3_9m_roc IS NOT NULL AND c5_3m_roc IS NOT NULL AND c2_sma200_pct IS NOT NULL AND c4_sma50_pct IS NOT NULL")


score_parts("raw_stock", "bars", "symbol")
score_parts("raw_pub", "published", "symbol")
score_parts("raw_ind", "idx", "industry_key")
SCORE = f"date, {', '.join(COMPONENTS)}, raw_score"
part("stock_scores0", f"SELECT symbol AS ticker, {SCORE}, group_name AS cap_bucket, market_cap, {sctr('raw_score', 'group_name')} AS sctr FROM raw_stock JOIN universe ON ticker = symbol")
part("stock_scores", "SELECT *, CAST(rank() OVER (PARTITION BY cap_bucket ORDER BY sctr DESC) AS INTEGER) AS rank_in_bucket FROM stock_scores0")
part("pub_scores0", f"SELECT raw_pub.symbol, {SCORE}, industry_key, sector_name AS gics_sector, industry_name, {sctr('raw_score')} AS sctr FROM raw_pub JOIN dim ON dim.symbol = raw_pub.symbol")
part("pub_scores", "SELECT *, CAST(rank() OVER (ORDER BY sctr DESC) AS INTEGER) AS rank FROM pub_scores0")
part("ind_scores0", f"SELECT industry_key, {SCORE}, sector_key, sector_name, industry_name, constituent_count, {sctr('raw_score')} AS sctr FROM raw_ind JOIN dim USING (industry_key) JOIN (SELECT industry_key, max(members) AS constituent_count FROM idx GROUP BY ALL) USING (industry_key)")
part("ind_scores", "SELECT *, CAST(rank() OVER (ORDER BY sctr DESC) AS INTEGER) AS rank FROM ind_scores0")
part("ind_breadth", f"SELECT industry_key, sector_name, industry_name, count(*) AS count, {r('median(sctr)', 1)} AS median_sctr, {r('avg(sctr)', 1)} AS mean_sctr, {', '.join(f'{r(f"avg(CASE WHEN sctr {op} THEN 1.0::DOUBLE ELSE 0 END) * 100", 1)} AS {n}' for n, op in (('pct_above_75', '> 75'), ('pct_above_50', '> 50'), ('pct_below_25', '< 25')))} FROM stock_scores JOIN members ON ticker = symbol JOIN dim USING (industry_key) GROUP BY ALL")
FINAL |= {
    "stock_sctr": "SELECT * FROM stock_scores",
    "bucket_summary": f"SELECT cap_bucket, count(*) AS stocks, {r('median(sctr)', 1)} AS median_sctr, max(sctr) AS max_sctr FROM stock_scores GROUP BY ALL",
    "top_stocks_by_bucket": "SELECT * FROM (SELECT ticker, cap_bucket, sctr, CAST(row_number() OVER (PARTITION BY cap_bucket ORDER BY sctr DESC, ticker) AS INTEGER) AS place FROM stock_scores) WHERE place <= 10",
    "index_sctr": "SELECT * FROM pub_scores",
    "industry_sctr": "SELECT * FROM ind_scores",
    "industry_breadth": "SELECT * FROM ind_breadth",
    "score_agreement": f"SELECT count(*) AS n, {r('corr(ra, rb)', 6)} AS spearman FROM (SELECT {share('a')} AS ra, {share('b')} AS rb FROM (SELECT x.sctr AS a, y.sctr AS b FROM ind_scores x JOIN pub_scores y ON lower(x.industry_name) = lower(y.industry_name)))",
}


# -- rotation --------------------------------------------------------------------------------------------------------


def quadrant(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} >= 100 AND {b} >= 100 THEN 'Leading' WHEN {a} >= 100 THEN 'Weakening' WHEN {b} < 100 THEN 'Lagging' ELSE 'Improving' END"


def rotation_parts(name: str, index: str, bench: str, unit: str) -> None:
    k = "industry_key"
    lag = f"OVER (PARTITION BY {k} ORDER BY date)"
    part(f"{name}_1", f"SELECT * FROM (SELECT {k}, date, {zscore('rs', 10, k)} AS ratio FROM (SELECT {k}, date, 100 * (i.close / nullif(b.close, 0)) AS rs FROM {index} i JOIN {bench} b USING (date))) WHERE ratio IS NOT NULL")
    part(f"{name}_2", f"SELECT {k}, date, ratio, 100 * (ratio / nullif(lag(ratio, 10) {lag}, 0) - 1) AS roc, {sma('ratio', 3, k)} AS rs_ratio FROM {name}_1")
    part(f"{name}_3", f"SELECT * FROM (SELECT *, {zscore('roc', 10, k)} AS mom FROM {name}_2) WHERE mom IS NOT NULL")
    part(f"{name}", f"SELECT {k}, date, rs_ratio, rs_momentum FROM (SELECT *, {sma('mom', 3, k)} AS rs_momentum FROM {name}_3) WHERE rs_ratio IS NOT NULL AND rs_momentum IS NOT NULL")
    tails = ", ".join(f"{r(f'lag({c}, {i}) {lag}', 3)} AS {c}_{i}{unit}" for i in range(1, 5) for c in ("rs_ratio", "rs_momentum"))
    direction = f"CASE WHEN lag(rs_ratio, 4) {lag} IS NULL THEN 'unknown' ELSE (CASE WHEN rs_ratio > lag(rs_ratio, 4) {lag} THEN 'right' ELSE 'left' END) || '-' || (CASE WHEN rs_momentum > lag(rs_momentum, 4) {lag} THEN 'up' ELSE 'down' END) END"
    part(f"{name}_snap", f"SELECT s.{k}, sector_key, sector_name, industry_name, constituent_count, rs_ratio, rs_momentum, quadrant, tail_direction, {', '.join(f'{c}_{i}{unit}' for i in range(1, 5) for c in ('rs_ratio', 'rs_momentum'))} FROM (SELECT {k}, {r('rs_ratio', 3)} AS rs_ratio, {r('rs_momentum', 3)} AS rs_momentum, {quadrant('rs_ratio', 'rs_momentum')} AS quadrant, {direction} AS tail_direction, {tails}, row_number() OVER (PARTITION BY {k} ORDER BY date DESC) AS i FROM {name}) s JOIN dim USING ({k}) JOIN (SELECT {k}, max(members) AS constituent_count FROM {index} GROUP BY ALL) USING ({k}) WHERE i = 1")


rotation_parts("rot", "idxw", "spy_weeks", "w")
rotation_parts("rotm", "idxm", "spy_months", "m")
FINAL |= {
    "rotation_series": f"SELECT industry_key, date, {r('rs_ratio', 4)} AS rs_ratio, {r('rs_momentum', 4)} AS rs_momentum FROM rot",
    "rrg_weekly": "SELECT * FROM rot_snap",
    "rrg_monthly": "SELECT * FROM rotm_snap",
    "rrg_tails": " UNION ALL ".join([*(f"SELECT industry_key, -{i} AS step, rs_ratio_{i}w AS rs_ratio, rs_momentum_{i}w AS rs_momentum FROM rot_snap WHERE rs_ratio_{i}w IS NOT NULL" for i in range(1, 5)), "SELECT industry_key, 0, rs_ratio, rs_momentum FROM rot_snap"]),
}

# -- strength and highs ----------------------------------------------------------------------------------------------

_LAGS = ", ".join(f"lag(p, {n}) OVER w AS p{n}, lag(b, {n}) OVER w AS b{n}" for n in (63, 126, 189, 252))


def excess(new: str, old: str) -> str:
    return r(f"{pct(f'p{new}', f'p{old}')} - {pct(f'b{new}', f'b{old}')}", 4)


part("ex1", "SELECT industry_key, date, i.close AS p, s.close AS b FROM idx i JOIN spy s USING (date)")
part("ex2", f"SELECT industry_key, date, p AS p0, b AS b0, {_LAGS}, (p / first_value(p) OVER w) / (b / first_value(b) OVER w) AS line, count(*) OVER (PARTITION BY industry_key) AS n, row_number() OVER (PARTITION BY industry_key ORDER BY date DESC) AS i FROM ex1 WINDOW w AS (PARTITION BY industry_key ORDER BY date)")
part("ex3", "SELECT *, max(line) OVER (PARTITION BY industry_key ORDER BY date ROWS 251 PRECEDING) AS top FROM ex2")
part("ex4", f"SELECT industry_key, {excess('0', '63')} AS rs_excess_3m, {excess('0', '126')} AS rs_excess_6m, {excess('0', '252')} AS rs_excess_12m, {excess('0', '63')} AS rs_q4, {excess('63', '126')} AS rs_q3, {excess('126', '189')} AS rs_q2, {excess('189', '252')} AS rs_q1, {pct('line', 'top')} AS off FROM ex3 WHERE i = 1 AND n >= 262")
part("ex5", f"SELECT * EXCLUDE (off), {r('(rs_q4 * 2 + rs_q3 + rs_q2 + rs_q1) / 5', 4)} AS rs_excess_comp, {r('off', 2)} AS rs_line_vs_52w, abs(off) <= 1.0 AS rs_new_high, abs(off) <= 3.0 AS rs_near_new_high FROM ex4")
part("strength0", f"SELECT ex5.*, sector_name, industry_name, {ibd('rs_excess_3m')} AS rs_pct_3m, {ibd('rs_excess_6m')} AS rs_pct_6m, {ibd('rs_excess_12m')} AS rs_pct_12m, {ibd('rs_excess_comp')} AS rs_pct_composite FROM ex5 JOIN dim USING (industry_key)")
part("strength", "SELECT *, CAST(row_number() OVER (ORDER BY rs_pct_composite DESC NULLS LAST, industry_key) AS INTEGER) AS rank FROM strength0")
part("ath1", "SELECT industry_key, last_day(date) AS date, arg_max(close, date) AS c FROM (SELECT * FROM idx QUALIFY count(*) OVER (PARTITION BY industry_key) >= 60) GROUP BY ALL")
part("ath2", "SELECT *, row_number() OVER (PARTITION BY industry_key ORDER BY date DESC) AS i, row_number() OVER (PARTITION BY industry_key ORDER BY date) AS k, count(*) OVER (PARTITION BY industry_key) AS n FROM ath1")
part("ath3", "SELECT industry_key, max(c) AS prev, arg_max(date, (c, -k)) AS prev_date FROM ath2 WHERE i > 1 GROUP BY ALL")
part("ath4", "SELECT l.*, prev, prev_date, l.c > prev AS new_ath, greatest(l.c, prev) AS lvl, (SELECT count(*) FROM ath2 h WHERE h.industry_key = l.industry_key AND h.k > coalesce((SELECT max(g.k) FROM ath2 g WHERE g.industry_key = l.industry_key AND NOT (g.c >= prev * 0.995::DOUBLE)), 0)) AS run, (SELECT count(*) FROM ath2 h WHERE h.industry_key = l.industry_key AND h.i > 1 AND h.k > coalesce((SELECT max(g.k) FROM ath2 g WHERE g.industry_key = l.industry_key AND g.i > 1 AND NOT (g.c >= prev * 0.995::DOUBLE)), 0)) AS run_before FROM ath2 l JOIN ath3 USING (industry_key) WHERE l.i = 1 AND l.n >= 6")
part("ath5", f"SELECT *, {pct('c', 'lvl')} AS p, CASE WHEN new_ath THEN 0 ELSE (year(date) - year(prev_date)) * 12 + month(date) - month(prev_date) END AS since FROM ath4")
part("ath6", f"""SELECT industry_key, sector_name, industry_name, {r('c', 2)} AS current_monthly, {r('lvl', 2)} AS monthly_ath, CASE WHEN new_ath THEN date ELSE prev_date END AS ath_date, {r('p', 2)} AS pct_from_ath, CAST(since AS INTEGER) AS months_since_ath, new_ath, since <= 3 AS recent_ath, {r('prev', 2)} AS prev_ath_level,
  CAST(CASE WHEN new_ath THEN run WHEN p > -3.0 THEN run_before ELSE 0 END AS INTEGER) AS months_holding_above_prev,
  CASE WHEN new_ath THEN 'New ATH' WHEN since <= 3 AND c >= prev * 0.985::DOUBLE THEN 'Holding Breakout' WHEN p >= -3 THEN 'Near ATH' WHEN since <= 12 AND p >= -15 THEN 'Recovering' ELSE 'Below ATH' END AS ath_signal,
  {r("CASE WHEN new_ath THEN 100.0::DOUBLE WHEN since <= 3 AND c >= prev * 0.985::DOUBLE THEN 85 WHEN p >= -3 THEN 70 WHEN since <= 12 AND p >= -15 THEN 40.0::DOUBLE + (15.0::DOUBLE + p) / 15.0::DOUBLE * 20 ELSE greatest(0.0::DOUBLE, 20.0::DOUBLE + p) END", 1)} AS ath_score FROM ath5 JOIN dim USING (industry_key)""")
part("ath", "SELECT *, CAST(row_number() OVER (ORDER BY ath_score DESC, pct_from_ath DESC, industry_key) AS INTEGER) AS rank FROM ath6")
FINAL |= {
    "rs_percentile": "SELECT * FROM strength",
    "strength_histogram": "SELECT CAST(CASE WHEN rs_pct_composite >= 90 THEN 90 WHEN rs_pct_composite >= 80 THEN 80 WHEN rs_pct_composite >= 70 THEN 70 WHEN rs_pct_composite >= 50 THEN 50 WHEN rs_pct_composite >= 1 THEN 1 END AS DOUBLE) AS at_least, count(*) AS n FROM strength WHERE rs_pct_composite IS NOT NULL GROUP BY ALL",
    "new_high_counts": "SELECT count(*) FILTER (rs_new_high) AS new_highs, count(*) FILTER (rs_near_new_high) AS near_highs FROM strength",
    "ath_monitor": "SELECT * FROM ath",
}

# -- stages and momentum ---------------------------------------------------------------------------------------------

STAGE = """CASE WHEN price > s200 AND s50 > s200 AND g > 0.05 AND price > s150 AND s150 > s200 AND g < 0.15 AND NOT price > s50 THEN '2C' WHEN price > s200 AND s50 > s200 AND g > 0.05 AND price > s150 AND s150 > s200 THEN '2B' WHEN price > s200 AND s50 > s200 AND g > 0.05 THEN '2A'
  WHEN price > s200 AND s50 > s200 AND abs(g) <= 0.05 THEN '2C' WHEN price > s200 AND NOT s50 > s200 THEN '3' WHEN NOT price > s200 AND s50 > s200 * 0.98::DOUBLE AND g > 0.05 THEN '3' WHEN NOT price > s200 AND NOT s50 > s200 AND (g < 0 OR abs(g) <= 0.05) THEN '4' ELSE '1' END"""
CRITERIA = {"minervini_c1_above_150": "price > s150", "minervini_c2_above_200": "price > s200", "minervini_c3_150_gt_200": "s150 > s200", "minervini_c4_200_rising": "g > 0", "minervini_c5_30pct_low": "from_low >= 30", "minervini_c6_near_high": "price >= high * 0.75::DOUBLE", "minervini_c7_rs70": "coalesce(rs, 0) >= 70"}


def stage_parts(name: str, series: str, key: str, rs: str) -> None:
    mean = lambda n, ago=0: f"avg(close) FILTER (i BETWEEN {ago + 1} AND {ago + n})"
    part(f"{name}_1", f"SELECT {key}, arg_max(close, date) AS price, {mean(50)} AS s50, {mean(150)} AS s150, {mean(200)} AS s200, CASE WHEN max(i) >= 220 THEN {mean(200, 20)} END AS old200, max(close) AS high, min(close) AS low FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date DESC) AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {series}) WHERE i <= 252 AND n >= 210 GROUP BY {key}")
    part(f"{name}_2", f"SELECT *, CASE WHEN old200 > 0 THEN {r(pct('s200', 'old200'), 3)} END AS slope, CASE WHEN low > 0 THEN {pct('price', 'low')} ELSE 0 END AS from_low, {rs} AS rs FROM {name}_1 t")
    part(f"{name}_3", f"SELECT *, coalesce(slope, 0) AS g FROM {name}_2")
    flags = ", ".join(f"{c} AS {n}" for n, c in CRITERIA.items())
    met = " + ".join(f"CAST({c} AS INTEGER)" for c in CRITERIA.values())
    part(name, f"""SELECT {key}, stage, CASE stage WHEN '2B' THEN 100 WHEN '2A' THEN 85 WHEN '2C' THEN 70 WHEN '3' THEN 25 WHEN '4' THEN 5 ELSE 45 END AS stage_score, {met} AS minervini_count, {flags}, {', '.join(f'{r(f"s{n}", 2)} AS sma{n}' for n in (50, 150, 200))}, slope AS sma200_slope, {', '.join(f'{r(pct("price", f"s{n}"), 2)} AS pct_vs_sma{n}' for n in (50, 150, 200))}, {r(pct('s50', 's200'), 2)} AS pct_sma50_vs_sma200,
      {r('high', 2)} AS high_52w, {r('low', 2)} AS low_52w, {r('CASE WHEN high > low THEN (price - low) / (high - low) * 100 ELSE 50.0 END', 1)} AS range_pos_52w, {r(pct('price', 'high'), 2)} AS pct_from_52w_high, {r('from_low', 2)} AS pct_from_52w_low, price > s50 AS above_sma50, price > s150 AS above_sma150, price > s200 AS above_sma200, s50 > s200 AS golden_cross, s150 > s200 AS sma150_gt_sma200 FROM (SELECT *, {STAGE} AS stage FROM {name}_3)""")


stage_parts("stock_stage", "bars", "symbol", "NULL")
stage_parts("ind_stage", "idx", "industry_key", "(SELECT any_value(rs_pct_composite) FROM strength s WHERE s.industry_key = t.industry_key)")
part("stages", "SELECT ind_stage.*, sector_name, industry_name, CAST(row_number() OVER (ORDER BY stage_score DESC, minervini_count DESC, industry_key) AS INTEGER) AS rank FROM ind_stage JOIN dim USING (industry_key)")
STRENGTH = "rs_pct_composite, rs_pct_3m, rs_pct_6m, rs_pct_12m, rs_excess_comp, rs_excess_3m, rs_excess_12m, rs_q4, rs_q3, rs_q2, rs_q1, rs_line_vs_52w, rs_new_high, rs_near_new_high"
part("mom1", f"SELECT x.industry_key, x.sector_name, x.industry_name, {STRENGTH}, sctr, c5_3m_roc, c6_ppo_slope, c2_sma200_pct, coalesce(stage, '?') AS stage, coalesce(minervini_count, 0) AS minervini_count, stage_score, range_pos_52w, pct_from_52w_high, sma200_slope FROM strength x LEFT JOIN ind_scores y USING (industry_key) LEFT JOIN stages z USING (industry_key)")
part("mom2", "SELECT *, coalesce(c2_sma200_pct > 0, false) AS above_200sma, CASE WHEN rs_pct_12m >= 80 THEN 1 WHEN rs_pct_12m >= 60 THEN 2 WHEN rs_pct_12m >= 40 THEN 3 WHEN rs_pct_12m >= 20 THEN 4 ELSE 5 END AS faber_quintile, rs_q1 + rs_q2 + rs_q3 AS mg_9m_score, coalesce(c5_3m_roc, 0.0) * 0.40::DOUBLE + coalesce(c6_ppo_slope, 0.0) * 0.60::DOUBLE AS sctr_st_raw, CASE WHEN c5_3m_roc IS NOT NULL AND c6_ppo_slope IS NOT NULL THEN c5_3m_roc * 0.40::DOUBLE + c6_ppo_slope * 0.60::DOUBLE END AS st_both FROM mom1")
part("mom3", f"""SELECT * EXCLUDE (st_both), CASE WHEN faber_quintile = 1 AND above_200sma AND stage = '2B' AND minervini_count >= 5 THEN 'STRONG BUY' WHEN faber_quintile = 1 AND above_200sma AND stage IN ('2A', '2B') THEN 'BUY' WHEN above_200sma AND ((faber_quintile = 2 AND stage IN ('2A', '2B')) OR (faber_quintile = 1 AND stage = '2C')) THEN 'HOLD' WHEN faber_quintile <= 2 AND stage = '1' AND above_200sma THEN 'WATCH' WHEN faber_quintile = 1 AND NOT above_200sma THEN 'CAUTION' ELSE 'EXIT' END AS faber_signal,
  {ibd('mg_9m_score')} AS mg_pct, CASE WHEN mg_9m_score IS NOT NULL THEN CAST(rank() OVER (ORDER BY mg_9m_score DESC NULLS LAST) AS INTEGER) END AS mg_rank, CAST({ibd('st_both')} AS DOUBLE) AS sctr_st FROM mom2""")
part("mom4", f"SELECT *, CASE WHEN mg_pct IS NULL THEN 'Unknown' WHEN mg_pct >= 80 THEN 'Leader' WHEN mg_pct >= 60 THEN 'Above Average' WHEN mg_pct >= 40 THEN 'Average' WHEN mg_pct >= 20 THEN 'Below Average' ELSE 'Laggard' END AS mg_signal, sctr_st - sctr AS st_lead, CASE WHEN sctr_st - sctr >= 10 THEN 'ST Leading' WHEN sctr_st - sctr <= -10 THEN 'ST Lagging' ELSE 'flat' END AS st_signal, {r('rs_pct_composite * 0.40::DOUBLE + sctr * 0.30::DOUBLE + sctr_st * 0.20::DOUBLE + mg_pct * 0.10::DOUBLE', 1)} AS momentum_score FROM mom3")
part("mom", f"SELECT *, {ibd('momentum_score')} AS momentum_pct, CAST(row_number() OVER (ORDER BY momentum_score DESC NULLS LAST, industry_key) AS INTEGER) AS rank FROM mom4")
FINAL |= {
    "stock_stages": "SELECT * FROM stock_stage",
    "stage_analysis": "SELECT * FROM stages",
    "stages_by_sector": "SELECT sector_name, stage, count(*) AS n FROM stages GROUP BY ALL",
    "criteria_table": f"SELECT sector_name, {', '.join(f'count(*) FILTER (minervini_count = {i}) AS met_{i}' for i in range(8))} FROM stages GROUP BY ALL",
    "momentum_screen": "SELECT * FROM mom",
    "short_term_leaders": "SELECT industry_key, st_lead FROM mom WHERE st_signal = 'ST Leading' ORDER BY st_lead DESC, industry_key LIMIT 15",
    "nine_month_leaders": "SELECT industry_key, mg_rank FROM mom WHERE mg_rank IS NOT NULL ORDER BY mg_rank, industry_key LIMIT 15",
    "signal_distribution": "SELECT faber_signal, mg_signal, count(*) AS n FROM mom GROUP BY ALL",
}

# -- breadth and structure -------------------------------------------------------------------------------------------


def part_share(condition: str) -> str:
    return r(f"coalesce(avg(CAST({condition} AS DOUBLE)) * 100, 0.0::DOUBLE)", 1)


part("brd", "SELECT s.industry_key, s.sector_name, stage, above_sma50, above_sma150, above_sma200, golden_cross, s.minervini_count, x.rs_pct_composite AS rs, x.rs_new_high AS nh, x.rs_near_new_high AS nn, faber_signal AS f, m.sctr, pct_from_ath AS pa FROM (SELECT industry_key, sector_name, stage, above_sma50, above_sma150, above_sma200, golden_cross, minervini_count FROM stages) s LEFT JOIN strength x USING (industry_key) LEFT JOIN (SELECT industry_key, faber_signal, sctr FROM mom) m USING (industry_key) LEFT JOIN ath USING (industry_key)")
_yes = lambda c: f"coalesce({c}, false)"
_MAIN = {"stage2_pct": _yes("stage IN ('2A', '2B')"), "stage2b_pct": _yes("stage = '2B'"), "above_sma200_pct": "above_sma200", "golden_cross_pct": "golden_cross", "rs_positive_pct": _yes("rs >= 50"), "rs_strong_pct": _yes("rs >= 80"), "sctr60_pct": _yes("sctr >= 60"), "faber_buy_pct": _yes("f IN ('STRONG BUY', 'BUY')")}
_MORE = {"stage1_pct": _yes("stage = '1'"), "stage2c_pct": _yes("stage = '2C'"), "stage3_pct": _yes("stage = '3'"), "stage4_pct": _yes("stage = '4'"), "above_sma150_pct": "above_sma150", "above_sma50_pct": "above_sma50", "minervini5_pct": _yes("minervini_count >= 5"), "minervini7_pct": _yes("minervini_count = 7"), "rs_newhigh_pct": _yes("nh"), "rs_nearhigh_pct": f"{_yes('nn')} OR {_yes('nh')}", "sctr80_pct": _yes("sctr >= 80"), "faber_strongbuy_pct": _yes("f = 'STRONG BUY'"), "faber_exit_pct": _yes("f = 'EXIT'"), "near_ath_pct": _yes("pa >= -5"), "at_ath_pct": _yes("pa >= -0.5")}
HEALTH = r("stage2_pct * 0.25::DOUBLE + above_sma200_pct * 0.20::DOUBLE + rs_positive_pct * 0.20::DOUBLE + golden_cross_pct * 0.20::DOUBLE + sctr60_pct * 0.15::DOUBLE", 1)
LABEL = "CASE WHEN health_score >= 80 THEN 'Bull Market' WHEN health_score >= 60 THEN 'Healthy' WHEN health_score >= 40 THEN 'Mixed' WHEN health_score >= 20 THEN 'Weak' ELSE 'Bear Market' END AS health_label"
_cols = lambda d: ", ".join(f"{part_share(c)} AS {n}" for n, c in d.items())
part("brd_all", f"SELECT *, {HEALTH} AS health_score FROM (SELECT count(*) AS n_industries, {_cols(_MAIN | _MORE)}, {r('avg(minervini_count)', 2)} AS minervini_avg, {r('median(sctr)', 1)} AS sctr_median FROM brd)")
part("brd_sector", f"SELECT *, {HEALTH} AS health_score FROM (SELECT sector_name, count(*) AS n_industries, {_cols(_MAIN)}, {r('avg(minervini_count)', 1)} AS minervini_avg, {r('median(sctr)', 1)} AS sctr_median FROM brd GROUP BY ALL)")
part("ma1", f"SELECT industry_key, date, close AS c, {sma('close', 50, 'industry_key')} AS m50, {sma('close', 200, 'industry_key')} AS m200, count(*) OVER (PARTITION BY industry_key) AS n FROM idx")
part("ma2", "SELECT *, lag(c, 14) OVER w AS c14, lag(m50, 14) OVER w AS m14, c > m50 AS a50, c > m200 AS a200 FROM ma1 WINDOW w AS (PARTITION BY industry_key ORDER BY date) QUALIFY row_number() OVER (PARTITION BY industry_key ORDER BY date DESC) = 1")
part("ma3", f"SELECT *, n >= 215 AND a50 AND coalesce(c14 < m14, false) AS crossed, {pct('c', 'm50')} AS p50, {pct('c', 'm200')} AS p200 FROM ma2 WHERE n >= 200")
part("ma4", "SELECT *, CASE WHEN a50 AND a200 THEN 75.0::DOUBLE + least(greatest(p50, 0.0::DOUBLE), 10.0::DOUBLE) * 1.5::DOUBLE WHEN a50 THEN 55 WHEN a200 THEN 40 ELSE greatest(20.0::DOUBLE + coalesce(p50, 0), 5.0::DOUBLE) END AS base FROM ma3")
FINAL |= {
    "market_breadth": f"SELECT *, {LABEL} FROM brd_all",
    "sector_breadth": f"SELECT *, {LABEL}, CAST(row_number() OVER (ORDER BY health_score DESC, sector_name) AS INTEGER) AS rank FROM brd_sector",
    "ma_structure": f"SELECT industry_key, a50 AS above_50sma, a200 AS above_200sma, crossed AS recent_50sma_cross, {r('p50', 2)} AS pct_from_50sma, {r('p200', 2)} AS pct_from_200sma, {r('CASE WHEN crossed THEN least(base + 10, 100.0::DOUBLE) ELSE base END', 1)} AS score_ma FROM ma4",
    "drawdown_window": "SELECT w0 AS start, w1 AS end FROM win",
}


def cases(x: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in table.items())
    return f"CASE {whens} ELSE {default} END"


_LABELS = " ".join(f"WHEN w.quadrant = '{a}' AND m.quadrant = '{b}' THEN '{v}'" for (a, b), v in TIMEFRAME_LABEL.items())
part("comp1", f"""SELECT s.industry_key, s.sector_name, s.industry_name, s.constituent_count, sctr, w.rs_ratio, w.rs_momentum, w.quadrant, w.tail_direction, m.rs_ratio AS rs_ratio_m, m.rs_momentum AS rs_momentum_m, m.quadrant AS quadrant_m, m.tail_direction AS tail_direction_m,
  CASE {_LABELS} ELSE '' END AS timeframe_label, median_sctr, pct_above_75, pct_below_25 FROM ind_scores s JOIN rot_snap w USING (industry_key) LEFT JOIN rotm_snap m USING (industry_key) LEFT JOIN ind_breadth b USING (industry_key)""")
_SCORE = f"0.40::DOUBLE * (greatest(0.0, least(99.9::DOUBLE, sctr)) / 99.9::DOUBLE * 100) + 0.30::DOUBLE * ({cases('quadrant', QUADRANT_SCORE, '50')}) + 0.15::DOUBLE * ({cases('tail_direction', TAIL_SCORE, '50')}) + 0.15::DOUBLE * ((greatest(-3.0, least(3.0, rs_momentum - 100)) + 3) / 6 * 100)"
part("comp2", f"SELECT *, CAST({cases('timeframe_label', TIMEFRAME_SCORE, '50')} AS DOUBLE) AS timeframe_score, {r(_SCORE, 1)} AS composite FROM comp1")
FINAL["rotation_composite"] = """SELECT *, CASE WHEN composite > 70 AND quadrant IN ('Leading', 'Improving') THEN 'Strong Rotation In' WHEN composite > 55 AND quadrant IN ('Leading', 'Improving') THEN 'Rotation In' WHEN composite >= 45 THEN 'Neutral' WHEN composite >= 30 AND quadrant IN ('Weakening', 'Lagging') THEN 'Rotation Out' ELSE 'Strong Rotation Out' END AS signal,
  concat_ws(' ', CASE WHEN sctr >= 75 THEN 'SCTR↑' WHEN sctr <= 25 THEN 'SCTR↓' END, CASE WHEN quadrant IN ('Leading', 'Improving') THEN 'RRG↑' ELSE 'RRG↓' END, CASE WHEN contains(tail_direction, 'right-up') THEN 'TAIL↑' WHEN contains(tail_direction, 'left-down') THEN 'TAIL↓' END, CASE WHEN pct_above_75 >= 50 THEN 'BRD↑' WHEN pct_above_75 <= 20 THEN 'BRD↓' END) AS convergence,
  CAST(row_number() OVER (ORDER BY composite DESC, industry_key) AS INTEGER) AS rank FROM comp2"""


# -- recursions over time, and what builds on them -------------------------------------------------------------------


def ewm_parts(name: str, series: str, key: str) -> None:
    """Fast, slow and signal means of a series, row by row."""
    a, b = "(2.0::DOUBLE / 13)", "(2.0::DOUBLE / 27)"
    part(f"{name}_n", f"SELECT {key}, date, close, row_number() OVER (PARTITION BY {key} ORDER BY date) AS i FROM {series}")
    f, w = f"((1 - {a}) * e.ema12 + {a} * n.close)", f"((1 - {b}) * e.ema26 + {b} * n.close)"
    ppo = f"(({f} - {w}) / {w} * 100)"
    part(name, f"SELECT {key}, date, close, i, close AS ema12, close AS ema26, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS hist FROM {name}_n WHERE i = 1 UNION ALL SELECT n.{key}, n.date, n.close, n.i, {f}, {w}, (1 - 0.2::DOUBLE) * e.sig + 0.2::DOUBLE * {ppo}, {ppo} - ((1 - 0.2::DOUBLE) * e.sig + 0.2::DOUBLE * {ppo}) FROM {name} e JOIN {name}_n n ON n.{key} = e.{key} AND n.i = e.i + 1")


ewm_parts("ewm_stock", "bars", "symbol")
ewm_parts("ewm_ind", "idx", "industry_key")
part("slope_ind", "SELECT industry_key, date, close, CASE WHEN before IS NOT NULL THEN greatest(-50.0, least(50.0, (hist - before) / 3)) END AS ppo_slope FROM (SELECT *, lag(hist, 3) OVER (PARTITION BY industry_key ORDER BY date) AS before FROM ewm_ind)")
_ROCS = {"c1_14m_roc": 14, "c3_9m_roc": 9, "c5_3m_roc": 3}
part("ser_m", "SELECT industry_key, last_day(date) AS d, arg_max(close, date) AS close FROM idx GROUP BY ALL")
part("ser_roc", f"SELECT industry_key, d, {', '.join(f'{pct("close", f"lag(close, {n}) OVER w")} AS {c}' for c, n in _ROCS.items())} FROM ser_m WINDOW w AS (PARTITION BY industry_key ORDER BY d)")
part("ser1", "SELECT *, CASE WHEN date = last_day(date) THEN date ELSE last_day(date - INTERVAL 1 MONTH) END AS d FROM slope_ind")
_FILL = "OVER (PARTITION BY industry_key ORDER BY date ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)"
part("ser2", f"SELECT industry_key, date, close, ppo_slope AS c6_ppo_slope, {', '.join(f'last_value({c} IGNORE NULLS) {_FILL} AS {c}' for c in _ROCS)}, {sma('close', 200, 'industry_key')} AS m200, {sma('close', 50, 'industry_key')} AS m50 FROM ser1 LEFT JOIN ser_roc USING (industry_key, d)")
part("ser", f"SELECT industry_key, date, {WEIGHTED} AS raw_score FROM (SELECT *, {pct('close', 'm200')} AS c2_sma200_pct, {pct('close', 'm50')} AS c4_sma50_pct FROM ser2)")
part("hist_days", f"SELECT max(date) AS date FROM idx GROUP BY {WEEK}")
part("hist_keys", "SELECT DISTINCT industry_key FROM idx")
part("hist_raw", "SELECT k.industry_key, d.date, CASE WHEN s.date >= d.date - 5 THEN s.raw_score END AS raw_score FROM hist_keys k CROSS JOIN hist_days d ASOF LEFT JOIN ser s ON s.industry_key = k.industry_key AND d.date >= s.date")
part("rot_keys", "SELECT DISTINCT industry_key FROM rot")
part("hist_rot", "SELECT k.industry_key, d.date, CASE WHEN s.date >= d.date - 30 THEN s.rs_ratio END AS rs_ratio, CASE WHEN s.date >= d.date - 30 THEN s.rs_momentum END AS rs_momentum FROM rot_keys k CROSS JOIN hist_days d ASOF LEFT JOIN rot s ON s.industry_key = k.industry_key AND d.date >= s.date")
part("hist1", f"SELECT industry_key, date, raw_score, {sctr('raw_score', 'date')} AS sctr FROM hist_raw")
part("hist2", f"SELECT industry_key, date, sctr, raw_score, {r('rs_ratio', 3)} AS rs_ratio, {r('rs_momentum', 3)} AS rs_momentum, {quadrant('rs_ratio', 'rs_momentum')} AS quadrant FROM hist1 FULL JOIN hist_rot USING (industry_key, date) WHERE sctr IS NOT NULL OR rs_ratio IS NOT NULL")
part("hist", f"""SELECT date, industry_key, sector_name, industry_name, sctr, {r('raw_score', 4)} AS raw_score, rs_ratio, rs_momentum, quadrant,
  CASE WHEN lag(rs_ratio, 4) OVER w IS NULL THEN 'unknown' ELSE (CASE WHEN rs_ratio > lag(rs_ratio, 4) OVER w THEN 'right' ELSE 'left' END) || '-' || (CASE WHEN rs_momentum > lag(rs_momentum, 4) OVER w THEN 'up' ELSE 'down' END) END AS tail_direction FROM hist2 JOIN dim USING (industry_key) WINDOW w AS (PARTITION BY industry_key ORDER BY date)""")
part("rsma1", f"SELECT industry_key, date, sector_name, industry_name, quadrant, rs_ratio AS x, {sma('rs_ratio', 13, 'industry_key')} AS ma, count(*) OVER (PARTITION BY industry_key) AS n, row_number() OVER (PARTITION BY industry_key ORDER BY date) AS i FROM hist WHERE rs_ratio IS NOT NULL")
part("rsma2", "SELECT *, i - coalesce(max(CASE WHEN NOT coalesce(x > ma, false) THEN i END) OVER (PARTITION BY industry_key ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS above, coalesce(lag(x) OVER w <= lag(ma) OVER w AND x > ma, false) AS up, coalesce(lag(x) OVER w >= lag(ma) OVER w AND x < ma, false) AS down, coalesce((ma - lag(ma, 4) OVER w) / 4, 0.0) AS slope FROM rsma1 WHERE n >= 17 WINDOW w AS (PARTITION BY industry_key ORDER BY date)")
part("rsma3", "SELECT *, up OR coalesce(lag(up) OVER w, false) AS cu, down OR coalesce(lag(down) OVER w, false) AS cd FROM rsma2 WINDOW w AS (PARTITION BY industry_key ORDER BY date) QUALIFY i = n")
part("rsma4", f"SELECT industry_key, sector_name, industry_name, quadrant, {r('x', 3)} AS rs_ratio_now, {r('ma', 3)} AS rs_ma13, x > ma AS rs_above_ma, CAST(above AS INTEGER) AS weeks_above_ma, cu AS rs_cross_up, cd AS rs_cross_down, {r('slope', 4)} AS rs_ma_slope, CASE WHEN cu THEN 'RS Cross Up' WHEN cd THEN 'RS Cross Down' WHEN x > ma AND slope > 0.005 THEN 'RS Above MA (rising)' WHEN x > ma AND slope < -0.005 THEN 'RS Above MA (fading)' WHEN x > ma THEN 'RS Above MA' WHEN slope < -0.005 THEN 'RS Below MA (falling)' WHEN slope > 0.005 THEN 'RS Below MA (recovering)' ELSE 'RS Below MA' END AS rs_ma_signal FROM rsma3")
FINAL |= {
    "exponential_means": f"SELECT symbol, date, close, {r('ema12', 6)} AS ema12, {r('ema26', 6)} AS ema26 FROM ewm_stock",
    "ppo_slope_days": f"SELECT industry_key, date, {r('ppo_slope', 6)} AS ppo_slope FROM slope_ind",
    "score_series": f"SELECT industry_key, date, {r('raw_score', 3)} AS raw_score FROM ser",
    "industry_history": "SELECT * FROM hist",
    "history_in_steps": "SELECT * FROM hist",
    "history_stats": "SELECT count(*) AS rows, count(DISTINCT date) AS dates, count(DISTINCT industry_key) AS industries, min(date) AS first_date, max(date) AS last_date FROM hist",
    "rs_ma_signals": "SELECT *, CAST(row_number() OVER (ORDER BY list_position(['RS Cross Up', 'RS Above MA (rising)', 'RS Above MA', 'RS Above MA (fading)', 'RS Below MA (recovering)', 'RS Cross Down', 'RS Below MA', 'RS Below MA (falling)'], rs_ma_signal), weeks_above_ma DESC, industry_key) AS INTEGER) AS rank FROM rsma4",
}


# -- severity --------------------------------------------------------------------------------------------------------

_BULL = "IN ('Leading', 'Improving')"
_BEAR = "IN ('Weakening', 'Lagging')"
part("hs_known", "SELECT industry_key, quadrant AS q, row_number() OVER (PARTITION BY industry_key ORDER BY date) AS i, count(*) OVER (PARTITION BY industry_key) AS n, last_value(quadrant) OVER (PARTITION BY industry_key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM hist WHERE quadrant IS NOT NULL")
part("hs_quad", "SELECT industry_key, any_value(now) AS now, any_value(n) AS n_quads, any_value(n) - coalesce(max(i) FILTER (q <> now), 0) AS weeks, coalesce(arg_max(q, i) FILTER (q <> now), '') AS before FROM hs_known GROUP BY industry_key")
part("hs_tail", "SELECT industry_key, rs_ratio - lag(rs_ratio, 4) OVER w AS dx, rs_momentum - lag(rs_momentum, 4) OVER w AS dy, rs_ratio, rs_momentum FROM hist WHERE rs_ratio IS NOT NULL AND rs_momentum IS NOT NULL WINDOW w AS (PARTITION BY industry_key ORDER BY date) QUALIFY row_number() OVER (PARTITION BY industry_key ORDER BY date DESC) = 1")
part("hs_trend", "SELECT industry_key, sctr, count(*) OVER (PARTITION BY industry_key) AS n, coalesce(sctr - lag(sctr, 4) OVER w, 0.0) AS d4, coalesce(sctr - lag(sctr, 12) OVER w, 0.0) AS d12 FROM hist WINDOW w AS (PARTITION BY industry_key ORDER BY date) QUALIFY row_number() OVER (PARTITION BY industry_key ORDER BY date DESC) = 1")
part("hs1", "SELECT t.*, now, n_quads, weeks, before, dx, dy, rs_ratio, rs_momentum, sqrt(dx * dx + dy * dy) AS speed, 101.5::DOUBLE - rs_ratio AS tx, 101.5::DOUBLE - rs_momentum AS ty, coalesce(n_quads, 0) < 2 AS few FROM hs_trend t LEFT JOIN hs_quad USING (industry_key) LEFT JOIN hs_tail USING (industry_key)")
part("hs", f"""SELECT industry_key, CASE WHEN n >= 13 THEN {r('sctr', 1)} END AS sctr, CASE WHEN n >= 13 THEN {r('d4', 1)} END AS sctr_4w_change, CASE WHEN n >= 13 THEN {r('d12', 1)} END AS sctr_12w_change,
  CASE WHEN n < 13 THEN 'insufficient' WHEN d4 > 2 AND d12 > 5 THEN 'accelerating' WHEN d4 > 2 OR d12 > 5 THEN 'rising' WHEN d4 < -2 AND d12 < -5 THEN 'decelerating' WHEN d4 < -2 OR d12 < -5 THEN 'falling' ELSE 'flat' END AS sctr_trend,
  {r("CASE WHEN n >= 13 AND sctr IS NOT NULL THEN (greatest(-40.0, least(40.0, d4 * 0.6::DOUBLE + d12 * 0.4::DOUBLE)) + 40) / 80 * 100 ELSE 50.0::DOUBLE END", 1)} AS score_sctr_mom, coalesce(now, '') AS quadrant, CAST(coalesce(weeks, 0) AS INTEGER) AS weeks_in_quadrant,
  {r(f"CASE WHEN now IS NULL THEN 50.0::DOUBLE WHEN now {_BULL} AND weeks <= 2 THEN 65 WHEN now {_BULL} AND weeks <= 8 THEN 70 + least(weeks - 2, 6) * 2.5::DOUBLE WHEN now {_BULL} THEN greatest(85.0::DOUBLE - (weeks - 8) * 2, 50) ELSE greatest(35.0::DOUBLE - weeks * 2, 10) END", 1)} AS score_persistence,
  CASE WHEN few THEN '' ELSE before END AS prev_quadrant, CASE WHEN few THEN 'insufficient' WHEN before = '' THEN 'stable-' || now ELSE before || '→' || now END AS transition,
  CAST(CASE WHEN few THEN 50 WHEN before = '' THEN (CASE WHEN now {_BULL} THEN 70 ELSE 30 END) WHEN before = 'Improving' AND now = 'Leading' THEN 90 WHEN before = 'Lagging' AND now = 'Improving' THEN 75 WHEN before = 'Weakening' AND now = 'Lagging' THEN 15 WHEN before = 'Leading' AND now = 'Weakening' THEN 25 WHEN now {_BULL} THEN 55 ELSE 35 END AS DOUBLE) AS score_transition,
  {r('dx', 3)} AS tail_dx, {r('dy', 3)} AS tail_dy, {r('speed', 3)} AS tail_speed, coalesce(dx > 0 AND dy > 0, false) AS toward_leading,
  {r("CASE WHEN dx IS NULL THEN 50.0::DOUBLE ELSE (least(speed / 0.6::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE + ((dx * tx + dy * ty) / ((speed + 1e-9) * (sqrt(tx * tx + ty * ty) + 1e-9)) + 1) / 2 * 0.5::DOUBLE) * 100 END", 1)} AS score_velocity FROM hs1""")
part("ma5", f"SELECT industry_key, a50 AS above_50sma, a200 AS above_200sma, crossed AS recent_50sma_cross, {r('p50', 2)} AS pct_from_50sma, {r('p200', 2)} AS pct_from_200sma, {r('CASE WHEN crossed THEN least(base + 10, 100.0::DOUBLE) ELSE base END', 1)} AS score_ma FROM ma4")
_SEV_LABELS = " ".join(f"WHEN hs.quadrant = '{a}' AND m.quadrant = '{b}' THEN '{v}'" for (a, b), v in TIMEFRAME_LABEL.items())
part("sev1", f"SELECT hs.*, coalesce(above_50sma, false) AS above_50sma, coalesce(above_200sma, false) AS above_200sma, coalesce(recent_50sma_cross, false) AS recent_50sma_cross, pct_from_50sma, pct_from_200sma, coalesce(score_ma, 50.0) AS score_ma, coalesce(m.quadrant, '') AS quadrant_m, m.rs_ratio AS rs_ratio_m, m.rs_momentum AS rs_momentum_m, CASE {_SEV_LABELS} ELSE '' END AS timeframe_label FROM hs LEFT JOIN ma5 USING (industry_key) LEFT JOIN rotm_snap m USING (industry_key)")
part("sev2", f"SELECT *, CAST({cases('timeframe_label', TIMEFRAME_SCORE, '50')} AS DOUBLE) AS score_timeframe FROM sev1")
part("sev3", f"SELECT *, {r('score_sctr_mom * 0.20::DOUBLE + score_persistence * 0.18::DOUBLE + score_transition * 0.18::DOUBLE + score_velocity * 0.17::DOUBLE + score_ma * 0.12::DOUBLE + score_timeframe * 0.15::DOUBLE', 1)} AS severity_score FROM sev2")
part("sev4", f"""SELECT s.*, coalesce(ath_signal, '') AS ath_signal, coalesce(ath_score, 50.0) AS ath_score, pct_from_ath, coalesce(rs_ma_signal, '') AS rs_ma_signal, coalesce(rs_cross_up, false) AS rs_cross_up, coalesce(rs_cross_down, false) AS rs_cross_down, weeks_above_ma AS rs_weeks_above_ma, x.rs_pct_composite, x.rs_pct_3m, x.rs_pct_12m, {r('x.rs_excess_comp', 1)} AS rs_excess_comp, {r('x.rs_line_vs_52w', 1)} AS rs_line_vs_52w,
  coalesce(x.rs_new_high, false) AS rs_new_high, coalesce(x.rs_near_new_high, false) AS rs_near_new_high, momentum_score, momentum_pct, coalesce(faber_signal, '') AS faber_signal, {r('sctr_st', 1)} AS sctr_st, {r('st_lead', 1)} AS st_lead, coalesce(st_signal, '') AS st_signal, coalesce(g.stage, '') AS stage, g.stage_score, g.minervini_count, d.sector_name, d.industry_name,
  CASE WHEN severity_score >= 80 AND s.quadrant {_BULL} AND quadrant_m {_BULL} THEN 'Both TF Confirmed' WHEN severity_score >= 80 AND s.quadrant {_BULL} THEN 'Strong Confirmed' WHEN severity_score >= 65 AND s.quadrant {_BULL} THEN 'Confirmed' WHEN severity_score >= 55 AND s.quadrant {_BULL} THEN 'Early Signal' WHEN s.quadrant {_BEAR} AND quadrant_m {_BULL} AND severity_score >= 50 THEN 'Pullback in Uptrend' WHEN severity_score >= 45 THEN 'Neutral / Watch' WHEN severity_score < 30 AND s.quadrant {_BEAR} AND quadrant_m {_BEAR} THEN 'Confirmed Exit' WHEN severity_score < 40 AND s.quadrant {_BEAR} THEN 'Weakening' ELSE 'Neutral / Watch' END AS label0
  FROM sev3 s LEFT JOIN ath USING (industry_key) LEFT JOIN rsma4 USING (industry_key) LEFT JOIN strength x USING (industry_key) LEFT JOIN mom y USING (industry_key) LEFT JOIN stages g USING (industry_key) LEFT JOIN dim d USING (industry_key)""")
part("sev5", """SELECT * EXCLUDE (label0), label0 || CASE WHEN label0 IN ('Both TF Confirmed', 'Strong Confirmed', 'Confirmed') AND ath_signal = 'New ATH' THEN ' + ATH' ELSE '' END || CASE WHEN label0 IN ('Both TF Confirmed', 'Strong Confirmed') OR (label0 = 'Confirmed' AND ath_signal <> 'New ATH') THEN (CASE WHEN rs_pct_composite >= 90 AND rs_new_high THEN ' ★RS' WHEN rs_pct_composite >= 80 THEN ' (RS≥80)' ELSE '' END) ELSE '' END AS severity_label FROM sev4""")
part("sev", "SELECT *, CAST(row_number() OVER (ORDER BY severity_score DESC, industry_key) AS INTEGER) AS rank FROM sev5")
_ORDER = {label: i for i, label in enumerate(SEVERITY_ORDER)}
part("sev_counts", "SELECT trim(regexp_replace(severity_label, '\\s*[\\(★].*$', '')) AS label, count(*) AS n FROM sev GROUP BY ALL")
FINAL |= {
    "history_scores": "SELECT * FROM hs",
    "rotation_severity": "SELECT * FROM sev",
    "severity_distribution": f"SELECT label, n, CAST(row_number() OVER (ORDER BY {cases('label', _ORDER, '2')} DESC, label) AS INTEGER) AS place FROM sev_counts",
    "enriched_severity": "SELECT sev.industry_key, severity_score, mg_pct, coalesce(mg_signal, '') AS mg_signal FROM sev LEFT JOIN mom USING (industry_key)",
}


def earlier(name: str) -> str | None:
    """The part of the market as of 1998-06-30 (o_ before a part's name): the same text on the trades up to that day."""
    if not name.startswith("o_") or name[2:] not in PARTS:
        return None
    if name == "o_trades":
        return PARTS["trades"] + " WHERE CAST(l_shipdate AS DATE) <= '1998-06-30'"
    return re.sub(rf"\b({'|'.join(dated())})\b", r"o_\1", PARTS[name[2:]])


def dated() -> list[str]:
    """The parts that depend on trades."""
    found = {"trades"}
    for name, sql in PARTS.items():
        if any(re.search(rf"\b{f}\b", sql) for f in found):
            found.add(name)
    return sorted(found, key=len, reverse=True)


def texts(queries: dict) -> dict[str, str]:
    """SQL of every query that has one."""
    late = set(dated())
    # the earlier market first: parts of both times refer to it, and a part has to stand before those that use it
    parts = {f"o_{n}": earlier(f"o_{n}") for n in PARTS if n in late}
    parts = {n: s for n, s in PARTS.items() if n not in late} | parts | {n: s for n, s in PARTS.items() if n in late}

    def needed(sql: str, seen: set[str]) -> set[str]:
        for name in set(re.findall(r"\b[a-z]\w*\b", sql)) & parts.keys():
            if name not in seen:
                seen.add(name)
                needed(parts[name], seen)
        return seen

    out = {}
    for name, final in FINAL.items():
        if name in queries:
            used = needed(final, set())
            clauses = ",\n".join(f"{p} AS ({parts[p]})" for p in parts if p in used)
            out[name] = f"WITH RECURSIVE {clauses}\n{final}"
    return out
