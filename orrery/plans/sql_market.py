"""SQL of the clock, window, leader, screener and snapshot queries, on the parts of ``sql``."""

from __future__ import annotations

import re

from orrery.plans.sql import BAR, FINAL, OHLC, PARTS, RESAMPLED, WEEK, ibd, part, pct, r, sma

# -- market clock ----------------------------------------------------------------------------------------------------

# States and thresholds of the clock.
_UP = "was IN ('Confirmed Uptrend', 'Uptrend Under Pressure', 'Uptrend Under Stress')"
CLOCK = "symbol, date, close, pct_chg, vol_ratio, state, rally_day, rally_day1_low, event, event_day, dd_count"


def clock_parts(name: str, bars: str, drop: float) -> None:
    """The clock's trace, bar by bar: one recursion step takes the next bar of every index."""
    part(f"{name}_n", f"SELECT symbol, date, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {bars}")
    first = f"SELECT symbol, date, low, close, volume, i, NULL::DOUBLE AS pct_chg, NULL::DOUBLE AS vol_ratio, 'Correction' AS state, 0 AS rally_day, NULL::DOUBLE AS rally_day1_low, NULL::VARCHAR AS event, NULL::INTEGER AS event_day, [0] AS flags, [close] AS closes FROM {name}_n WHERE i = 1"
    bar = f"SELECT n.*, (n.close / nullif(e.close, 0) - 1) * 100 AS pct, n.volume / nullif(e.volume, 0) AS ratio, CASE WHEN e.volume = 0 AND n.volume > 0 THEN 1e300 ELSE coalesce(n.volume / nullif(e.volume, 0), 1) END AS v, e.state AS was, e.rally_day AS day, e.rally_day1_low AS floor, e.flags AS fl, e.closes AS cl FROM {name} e JOIN {name}_n n ON n.symbol = e.symbol AND n.i = e.i + 1"
    kind = f"SELECT *, CASE WHEN {_UP} AND pct <= -0.20 AND v > 1 THEN 'Distribution' WHEN {_UP} AND pct BETWEEN 0 AND 0.40 AND v >= 1.50 THEN 'Stall' END AS kind FROM ({bar})"
    lists = f"SELECT *, list_append(fl, CASE WHEN kind IS NULL THEN 0 ELSE 1 END)[-25:] AS flags, list_append(cl, close)[-25:] AS closes, was = 'Rally Attempt' AND close >= floor AND day + 1 >= 4 AND pct >= 1.25 AND v > 1 AS ftd FROM ({kind})"
    state = f"CASE WHEN was = 'Correction' THEN (CASE WHEN pct > 0 THEN 'Rally Attempt' ELSE was END) WHEN was = 'Rally Attempt' THEN (CASE WHEN close < floor THEN 'Correction' WHEN coalesce(ftd, false) THEN 'Confirmed Uptrend' ELSE was END) WHEN close < list_max(closes) * (1 - {drop}::DOUBLE / 100) THEN 'Correction' WHEN list_sum(flags) >= 6 THEN 'Uptrend Under Stress' WHEN list_sum(flags) >= 5 THEN 'Uptrend Under Pressure' ELSE 'Confirmed Uptrend' END"
    stepped = f"SELECT *, {state} AS state FROM ({lists})"
    part(name, f"{first} UNION ALL SELECT symbol, date, low, close, volume, i, pct, ratio, state, CASE WHEN state <> 'Rally Attempt' THEN 0 WHEN was = 'Correction' THEN 1 ELSE day + 1 END, CASE WHEN state <> 'Rally Attempt' THEN NULL WHEN was = 'Correction' THEN low ELSE floor END, CASE WHEN coalesce(ftd, false) THEN 'Follow-Through' ELSE kind END, CASE WHEN coalesce(ftd, false) THEN day + 1 END, flags, closes FROM ({stepped})")
    part(f"{name}_t", f"SELECT symbol, date, close, pct_chg, vol_ratio, state, rally_day, rally_day1_low, event, event_day, CAST(list_sum(flags) AS INTEGER) AS dd_count FROM {name}")


_GRADE = "CASE WHEN event = 'Stall' THEN 'Mild' WHEN event = 'Distribution' AND abs(pct_chg) >= 1.0 AND vol_ratio >= 1.4 THEN 'Severe' WHEN event = 'Distribution' AND abs(pct_chg) >= 0.5 AND vol_ratio >= 1.3 THEN 'Moderate' WHEN event = 'Distribution' THEN 'Mild' WHEN abs(pct_chg) >= 2.0 AND vol_ratio >= 1.5 THEN 'Strong' WHEN abs(pct_chg) >= 1.5 THEN 'Good' ELSE 'Weak' END"
clock_parts("clk3", "clock_bars", 3.0)
clock_parts("clk7", "clock_bars", 7.0)
part("clock_cut", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY symbol) AS m FROM clock_bars) WHERE k <= 300 AND least(m, 300) >= 50")
clock_parts("clkm", "clock_cut", 7.0)
_TRACE = f"SELECT symbol, date, {r('close', 6)} AS close, {r('pct_chg', 6)} AS pct_chg, {r('vol_ratio', 6)} AS vol_ratio, state, rally_day, {r('rally_day1_low', 6)} AS rally_day1_low, event, event_day, dd_count FROM"
part("market_state", f"""SELECT symbol AS ticker, max(date) AS as_of_date, arg_max(close, date) AS close, CASE WHEN arg_max(state, date) = 'Rally Attempt' AND arg_max(rally_day, date) > 0 THEN 'Rally Attempt ' || arg_max(rally_day, date) ELSE arg_max(state, date) END AS state, arg_max(rally_day, date) AS rally_day, arg_max(dd_count, date) AS dd_count_25d, arg_max(dd_count, date) >= 5 AS dd_under_pressure,
  max(date) FILTER (event = 'Follow-Through') AS last_ftd_date, {r("arg_max(pct_chg, date) FILTER (event = 'Follow-Through')", 2)} AS last_ftd_gain_pct, {r("arg_max(vol_ratio, date) FILTER (event = 'Follow-Through')", 2)} AS last_ftd_vol_ratio, arg_max(event_day, date) FILTER (event = 'Follow-Through') AS last_ftd_day FROM clkm_t GROUP BY symbol""")
part("clock_days", f"SELECT symbol, date, event AS type, {r('pct_chg', 2)} AS pct_chg, {r('vol_ratio', 2)} AS vol_ratio, {r('close', 2)} AS close, {_GRADE} AS grade, event_day FROM clk3_t WHERE event IS NOT NULL")
FINAL |= {
    "clock_trace": f"{_TRACE} clk3_t",
    "streamed_clock": f"{_TRACE} clk7_t",
    "clock_events": "SELECT * FROM clock_days",
    "market_clock": "SELECT * FROM market_state",
    "event_counts": "SELECT symbol, count(*) FILTER (type = 'Follow-Through') AS follow_throughs, count(*) FILTER (type = 'Distribution') AS distributions, count(*) FILTER (type = 'Stall') AS stalls, max(date) FILTER (type = 'Distribution') AS last_distribution FROM clock_days GROUP BY symbol",
}

# -- windows and leaders ---------------------------------------------------------------------------------------------

part("nation_days", f"SELECT industry_key AS symbol, date, {OHLC} FROM trades JOIN members ON stock = members.symbol GROUP BY ALL")
part("nation_weeks0", f"SELECT symbol, {WEEK} AS d, {RESAMPLED} FROM nation_days GROUP BY ALL")
part("nation_weeks", "SELECT symbol, d AS date, open, high, low, close, volume FROM nation_weeks0")
part("win_deep", "SELECT date, (close / max(close) OVER (ORDER BY date) - 1) * 100 <= -1.0 AS deep FROM spy_weeks")
part("win_runs", "SELECT date, deep, sum(CASE WHEN deep THEN 0 ELSE 1 END) OVER (ORDER BY date) AS run FROM win_deep")
part("win", "SELECT coalesce((SELECT min(date) FROM win_runs WHERE deep AND date < w1 GROUP BY run ORDER BY run DESC LIMIT 1), w1 - 30) AS w0, w1 FROM (SELECT max(date) AS w1 FROM spy_weeks)")
part("ftd_end", "SELECT coalesce(max(date) FILTER (event = 'Follow-Through'), max(date)) AS e FROM clk3_t WHERE symbol = 'SPY'")
part("ftd_runs", "SELECT date, deep, sum(CASE WHEN deep THEN 0 ELSE 1 END) OVER (ORDER BY date) AS run FROM (SELECT date, (close / max(close) OVER (ORDER BY date) - 1) * 100 <= -1.0 AS deep FROM spy, ftd_end WHERE date <= e)")
part("top_weeks", "SELECT date, close, row_number() OVER (ORDER BY date DESC) AS k FROM spy_weeks QUALIFY k <= 60")
part("top_found", "SELECT * FROM (SELECT max({'c': close, 'k': k, 'd': date}) AS t, arg_max(close, date) AS last, max(date) AS e FROM top_weeks) WHERE (t.c - last) / t.c * 100 >= 0.1")
FINAL["peak_window"] = "SELECT min(date) AS start, e AS end FROM top_weeks, top_found WHERE date > t.d GROUP BY e"
FINAL["clock_window"] = "SELECT coalesce((SELECT min(date) FROM ftd_runs, ftd_end WHERE deep AND date < e GROUP BY run ORDER BY run DESC LIMIT 1), e - 30) AS start, e AS end FROM ftd_end"


def leader_parts(name: str, bars: str, spy: str, members: str, min_days: int, warmup: int) -> None:
    part(f"{name}_c", f"SELECT symbol, date, high, low, close, coalesce(volume, 0) AS volume, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {bars}, win WHERE date BETWEEN w0 - {warmup} AND w1 AND high > low")
    part(f"{name}_e", f"SELECT *, close AS ema21 FROM {name}_c WHERE i = 1 UNION ALL SELECT n.*, (1 - 2.0::DOUBLE / 22) * e.ema21 + 2.0::DOUBLE / 22 * n.close FROM {name}_e e JOIN {name}_c n ON n.symbol = e.symbol AND n.i = e.i + 1")
    part(f"{name}_s", f"SELECT e.*, {sma('e.close', 50, 'symbol').replace('ORDER BY date', 'ORDER BY e.date')} AS m, (e.close - low) / (high - low) * 100 AS cr, e.close / last_value(CASE WHEN s.close <> 0 THEN s.close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY e.date ROWS UNBOUNDED PRECEDING) AS rs FROM {name}_e e LEFT JOIN (SELECT date, close FROM {spy}, win WHERE date BETWEEN w0 - {warmup} AND w1) s ON s.date = e.date")
    part(f"{name}_i", f"SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM {name}_s, win WHERE date >= w0")
    part(f"{name}_a", f"""SELECT symbol, count(*) AS n, count(*) FILTER (cr >= 60) AS strong, count(*) FILTER (close > {r('ema21', 9)}) AS above, arg_min(rs, date) AS rs0, arg_max(rs, date) AS rs1, arg_max(close, date) AS c1, last(m ORDER BY date) AS m1, avg(cr) AS cr_mean, coalesce(sum(volume) FILTER (close > prev), 0) AS up, coalesce(sum(volume) FILTER (close < prev), 0) AS down FROM {name}_i GROUP BY symbol HAVING count(*) >= {min_days}""")
    flags = {"f1_cr": "strong / n >= 0.60::DOUBLE", "f2_ema21": "above / n >= 0.70::DOUBLE", "f3_rs_spy": "coalesce(rs0 > 0 AND rs1 > rs0, false)", "f4_above_50sma": f"coalesce(c1 > {r('m1', 9)}, false)", "f5_accum": "up > down"}
    total = " + ".join(f"CAST({f} AS INTEGER)" for f in flags.values())
    part(f"{name}_f", f"""SELECT symbol AS ticker, {total} AS leader_score, {', '.join(f'{f} AS {k}' for k, f in flags.items())}, {r('cr_mean', 1)} AS cr_mean, CAST(strong AS INTEGER) AS cr_strong_days, CAST(n AS INTEGER) AS corr_days, {r('above / n * 100', 1)} AS ema21_held_pct,
      {r(f"CASE WHEN rs0 > 0 THEN {pct('rs1', 'rs0')} END", 2)} AS rs_chg_pct, {r(f"CASE WHEN m1 > 0 THEN {pct('c1', 'm1')} END", 2)} AS pct_vs_sma50, {r('up / nullif(up + down, 0) * 100', 1)} AS up_vol_pct FROM {name}_a""")
    part(name, f"SELECT f.*, k.industry_key, dim.sector_name, dim.industry_name, coalesce(mom.faber_signal, '') AS faber_signal, CAST(row_number() OVER (ORDER BY leader_score DESC, f.cr_mean DESC, ticker, k.industry_key) AS INTEGER) AS rank FROM {name}_f f JOIN {members} k ON k.symbol = ticker LEFT JOIN dim ON dim.industry_key = k.industry_key LEFT JOIN mom ON mom.industry_key = k.industry_key")


part("self_members", "SELECT industry_key AS symbol, industry_key FROM dim")
part("stock_members", "SELECT symbol, industry_key FROM members")
leader_parts("ldn", "nation_weeks", "spy_weeks", "self_members", 2, 500)
leader_parts("lds", "bars", "spy", "stock_members", 2, 60)
FINAL |= {
    "closing_range_leaders": "SELECT * FROM ldn",
    "leader_counts": "SELECT leader_score, count(*) AS n, median(corr_days) AS median_days FROM ldn GROUP BY ALL",
    "leaders_of_strong_industries": "SELECT * EXCLUDE (rank), CAST(row_number() OVER (ORDER BY leader_score DESC, cr_mean DESC, ticker, industry_key) AS INTEGER) AS rank FROM ldn WHERE industry_key IN (SELECT industry_key FROM mom WHERE rank <= 8)",
}

part("cl_n", "SELECT b.symbol, b.date, high, low, b.close, volume, row_number() OVER (PARTITION BY b.symbol ORDER BY b.date) AS i FROM nation_weeks b JOIN ind_scores ON industry_key = b.symbol, win WHERE b.date <= w1 AND b.close IS NOT NULL AND sctr >= 0")
part("cl_e", "SELECT *, close AS e FROM cl_n WHERE i = 1 UNION ALL SELECT n.*, (1 - 2.0::DOUBLE / 22) * e.e + 2.0::DOUBLE / 22 * n.close FROM cl_e e JOIN cl_n n ON n.symbol = e.symbol AND n.i = e.i + 1")
part("cl_s", f"SELECT c.*, CASE WHEN i >= 21 THEN e END AS ema21, {sma('c.close', 50, 'symbol').replace('ORDER BY date', 'ORDER BY c.date')} AS s50, {sma('c.close', 200, 'symbol').replace('ORDER BY date', 'ORDER BY c.date')} AS s200, lag(c.close, 63) OVER w AS c63, CASE WHEN lag(c.date) OVER w >= w0 THEN lag(c.close) OVER w END AS prev, CASE WHEN high > low THEN (c.close - low) / (high - low) * 100 END AS cr, c.close / nullif(s.close, 0) AS rs, c.date >= w0 AS ins, c.date < w0 AS pre, c.date < w0 AND c.date >= w0 - 30 AS justb FROM cl_e c CROSS JOIN win LEFT JOIN spy_weeks s ON s.date = c.date WINDOW w AS (PARTITION BY symbol ORDER BY c.date)")
part("cl_a", f"""SELECT symbol, count(*) AS n, count(*) FILTER (ins) AS days, count(cr) FILTER (ins) AS cr_n, count(*) FILTER (ins AND cr > 60) AS cr_up, count(*) FILTER (ins AND close > {r('ema21', 9)}) AS ema_up, last(close ORDER BY date) AS lastc, last(ema21 ORDER BY date) AS l21, last(s50 ORDER BY date) AS l50, last(s200 ORDER BY date) AS l200, count(rs) FILTER (ins) AS rs_n,
  arg_min(rs, date) FILTER (ins AND rs IS NOT NULL) AS rs0, arg_max(rs, date) FILTER (ins AND rs IS NOT NULL) AS rs1, count(*) FILTER (pre) AS pre_n, last(close ORDER BY date) FILTER (pre) AS pre_c, last(s50 ORDER BY date) FILTER (pre) AS pre_m, last(c63 ORDER BY date) FILTER (pre) AS pre_63, coalesce(sum(coalesce(volume, 0)) FILTER (ins AND close > prev), 0) AS up, coalesce(sum(coalesce(volume, 0)) FILTER (ins AND close < prev), 0) AS down, max(high) FILTER (ins) AS topc, max(close) FILTER (justb) AS pre_high FROM cl_s GROUP BY symbol""")
part("cl_b", f"SELECT a.*, sctr, cr_up / cr_n AS cr_share, ema_up / days AS ema_share, CASE WHEN rs_n >= 2 AND rs0 > 0 THEN {pct('rs1', 'rs0')} END AS rsc, coalesce(pre_n >= 65 AND pre_c > {r('pre_m', 9)}, false) AS pa, coalesce(pre_n >= 65 AND pre_63 > 0 AND pre_c > pre_63, false) AS pr, CASE WHEN days >= 2 THEN (CASE WHEN down > 0 THEN up / down ELSE 2.0 END) END AS acc FROM cl_a a JOIN ind_scores ON industry_key = symbol WHERE n >= 200 AND days >= 3 AND cr_n > 0")
part("cl_c", f"""SELECT symbol AS ticker, 'industry' AS cap_bucket, {r('sctr', 1)} AS sctr, CAST(days AS INTEGER) AS corr_days, {r('cr_share * 100', 1)} AS cr_above_60_pct, {r('ema_share * 100', 1)} AS ema21_pct, ema_share >= 0.70::DOUBLE AS held_21ema, coalesce(lastc > {r('l21', 9)}, false) AS above_21ema, coalesce(lastc > {r('l50', 9)}, false) AS above_50sma, coalesce(lastc > {r('l200', 9)}, false) AS above_200sma, {r('rsc', 2)} AS rs_change_pct, coalesce(rsc > 0, false) AS rs_positive,
  CAST(pa AS INTEGER) + CAST(pr AS INTEGER) >= 2 AS was_strong_pre, pa AS was_above_50sma_pre, pr AS roc_3m_positive_pre, {r('acc', 2)} AS acc_ratio, coalesce(acc >= 1, false) AS is_accumulating,
  CAST(cr_share >= 0.2::DOUBLE AS INTEGER) + CAST(ema_share >= 0.70::DOUBLE AS INTEGER) + CAST(coalesce(rsc > 0, false) AS INTEGER) + CAST(pa AND pr AS INTEGER) + CAST(coalesce(acc >= 1, false) AS INTEGER) AS filters_passed, {r(pct('lastc', 'topc'), 1)} AS drawdown_pct, {r(pct('lastc', 'pre_high'), 1)} AS vs_pre_high_pct,
  {r("cr_share * 100 * 0.25::DOUBLE + coalesce(greatest(0.0, least(100.0, 50 + rsc * 10)), 50.0) * 0.22::DOUBLE + ema_share * 100 * 0.18::DOUBLE + (CAST(pa AS INTEGER) + CAST(pr AS INTEGER)) / 2.0::DOUBLE * 100 * 0.15::DOUBLE + coalesce(greatest(0.0, least(100.0, 60 + (acc - 1) * 30)), 50.0) * 0.12::DOUBLE + least(sctr, 99.9::DOUBLE) * 0.08::DOUBLE", 1)} AS composite FROM cl_b""")
FINAL["correction_leaders"] = "SELECT c.*, dim.industry_key, sector_name, industry_name, CAST(row_number() OVER (ORDER BY composite DESC, ticker) AS INTEGER) AS rank FROM cl_c c LEFT JOIN dim ON dim.industry_key = ticker WHERE above_50sma AND cr_above_60_pct >= 20"

# -- screener and breadth --------------------------------------------------------------------------------------------

_BASE = lambda x: f"coalesce(lag({x}, 251) OVER w, first_value({x}) OVER w)"
part("x12", f"SELECT b.symbol, b.date, {r(f'{pct("b.close", _BASE("b.close"))} - {pct("s.close", _BASE("s.close")).replace("((", "(((", 1)})', 2)} AS rs_12m, count(*) OVER (PARTITION BY b.symbol) AS n, row_number() OVER (PARTITION BY b.symbol ORDER BY b.date DESC) AS k FROM bars b JOIN spy s ON s.date = b.date WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date)")
part("scr1", f"""SELECT g.symbol, k.industry_key, mom.faber_signal AS ind_faber, i.stage AS ind_stage, g.stage, g.stage_score, g.minervini_count, rs_12m, coalesce(leader_score, 0) AS cr_score, coalesce(s.sctr, 50.0) AS sctr, o.sctr AS sctr_hist, g.pct_vs_sma200, g.pct_vs_sma150, g.sma200_slope, g.range_pos_52w, g.pct_from_52w_high, g.golden_cross, {ibd('rs_12m')} AS rs_pct
  FROM stock_stage g JOIN members k ON k.symbol = g.symbol JOIN mom ON mom.industry_key = k.industry_key AND mom.faber_signal IN ('STRONG BUY', 'BUY', 'HOLD', 'WATCH', 'CAUTION', 'EXIT') LEFT JOIN (SELECT symbol, rs_12m FROM x12 WHERE k = 1 AND n >= 200) x ON x.symbol = g.symbol LEFT JOIN stages i ON i.industry_key = k.industry_key LEFT JOIN lds ON lds.ticker = g.symbol LEFT JOIN stock_scores s ON s.ticker = g.symbol LEFT JOIN o_stock_scores o ON o.ticker = g.symbol""")
part("scr2", f"SELECT *, {r('coalesce(rs_pct, 50) * 0.35::DOUBLE + stage_score * 0.30::DOUBLE + minervini_count / 7 * 100 * 0.15::DOUBLE + sctr * 0.10::DOUBLE + cr_score / 5 * 100 * 0.10::DOUBLE', 1)} AS composite FROM scr1 WHERE stage IN ('2A', '2B') AND minervini_count >= 1")
_SCREEN = f"SELECT symbol AS ticker, c.industry_key, industry_name, sector_name, ind_faber, ind_stage, stage, stage_score, minervini_count, rs_12m, cr_score, sctr, sctr_hist, pct_vs_sma200, pct_vs_sma150, sma200_slope, range_pos_52w, pct_from_52w_high, golden_cross, rs_pct, composite, {ibd('composite')} AS composite_pct, CAST(row_number() OVER (ORDER BY composite DESC, c.symbol) AS INTEGER) AS rank FROM scr2 c"
part("screen", _SCREEN.replace("SELECT symbol", "SELECT c.symbol") + " LEFT JOIN dim USING (industry_key)")
FINAL |= {
    "stock_screener": "SELECT * FROM screen",
    "screener_buckets": "SELECT CAST(CASE WHEN composite >= 80 THEN 80 WHEN composite >= 70 THEN 70 WHEN composite >= 60 THEN 60 WHEN composite >= 50 THEN 50 END AS DOUBLE) AS at_least, count(*) AS n FROM screen WHERE composite IS NOT NULL GROUP BY ALL",
    "filtered_stocks": f"SELECT count(*) AS stocks, count(DISTINCT industry_key) AS industries, {r('avg(composite)', 1)} AS avg_composite, {r('avg(rs_pct)', 1)} AS avg_rs, count(*) FILTER (cr_score = 5) AS full_leaders FROM screen WHERE composite >= 40 AND minervini_count >= 2 AND coalesce(rs_pct, 0) >= 20",
}
_STATE = "coalesce(state, '')"
FINAL["breadth_reading"] = f"""SELECT health_score, state AS clock_state, dd_count_25d AS clock_dds, CASE WHEN contains({_STATE}, 'Uptrend') AND health_score >= 60 THEN (CASE WHEN contains({_STATE}, 'Stress') OR contains({_STATE}, 'Pressure') THEN 'confirmed bull, distribution elevated' ELSE 'confirmed bull' END) WHEN contains({_STATE}, 'Uptrend') THEN 'narrow leadership'
  WHEN contains({_STATE}, 'Rally') AND health_score >= 55 THEN 'rally with support' WHEN contains({_STATE}, 'Rally') THEN 'suspect rally' WHEN contains({_STATE}, 'Correction') THEN (CASE WHEN health_score >= 50 THEN 'selective correction' ELSE 'broad correction' END) ELSE 'unknown' END AS interpretation FROM brd_all LEFT JOIN market_state ON ticker = 'SPY'"""
FINAL["breadth_change"] = f"SELECT a.metric, CAST(a.value AS DOUBLE) AS value, CAST(b.value AS DOUBLE) AS previous, {r('CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)', 2)} AS delta FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM brd_all) ON COLUMNS(*) INTO NAME metric VALUE value) a JOIN (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM o_brd_all) ON COLUMNS(*) INTO NAME metric VALUE value) b USING (metric)"

# -- snapshots -------------------------------------------------------------------------------------------------------

# Order of the labels, from weakest to strongest.
_SEVERITY = ["Confirmed Exit", "Weakening", "Neutral / Watch", "Pullback in Uptrend", "Early Signal", "Confirmed", "Confirmed + ATH", "Strong Confirmed", "Strong Confirmed + ATH", "Both TF Confirmed", "Both TF Confirmed + ATH"]
_ORDERS = {
    "faber_signal": ["EXIT", "CAUTION", "WATCH", "HOLD", "BUY", "STRONG BUY"],
    "stage": ["4", "3", "1", "2C", "2A", "2B"],
    "quadrant": ["Lagging", "Weakening", "Improving", "Leading"],
    "quadrant_m": ["Lagging", "Weakening", "Improving", "Leading"],
    "ath_signal": ["Below ATH", "Recovering", "Near ATH", "Holding Breakout", "New ATH"],
}
_LABELS = ["severity_label", *_ORDERS]
_NUMBERS = ["severity_score", "minervini_count", "rs_pct_composite", "rs_pct_3m", "sctr"]
_place = lambda x, order, default=0: f"coalesce(nullif(list_position({order}, {x}), 0) - 1, {default})"
_plain = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '\\s*[\\(★].*$', ''))"
_side = lambda p, s: ", ".join([f"trim(coalesce({c}, '')) AS {c}{s}" for c in _LABELS] + [f"{c} AS {c}{s}" for c in _NUMBERS])
part("cmp0", f"SELECT * REPLACE (coalesce(industry_name, '') AS industry_name, coalesce(sector_name, '') AS sector_name) FROM (SELECT industry_key, industry_name, sector_name, {_side('', '')} FROM sev) FULL JOIN (SELECT industry_key, {_side('', '_prev')} FROM o_sev) USING (industry_key)")
_deltas = ", ".join([f"{r(f'{c} - {c}_prev', 2)} AS {c}_delta" for c in _NUMBERS] + [f"CAST({_place(c, o)} - {_place(f'{c}_prev', o)} AS INTEGER) AS {c}_rank_delta" for c, o in _ORDERS.items()])
part("cmp1", f"SELECT *, {_deltas}, CAST({_place(_plain('severity_label'), _SEVERITY, 2)} - {_place(_plain('severity_label_prev'), _SEVERITY, 2)} AS INTEGER) AS sev_rank_delta, coalesce(severity_label_prev, '') = '' AS is_new, coalesce(severity_label, '') = '' AS is_dropped FROM cmp0")
part("cmp2", "SELECT *, sev_rank_delta <> 0 OR faber_signal_rank_delta <> 0 OR stage_rank_delta <> 0 OR quadrant_rank_delta <> 0 OR coalesce(abs(severity_score_delta) >= 2.0, false) OR coalesce(abs(rs_pct_composite_delta) >= 5.0, false) AS any_change FROM cmp1")
_said = lambda name, c: f"CASE WHEN {c} <> {c}_prev AND {c}_prev <> '' THEN '{name}: ' || {c}_prev || ' → ' || {c} END"
_signed = lambda c: f"printf('%+d', CAST({c} AS BIGINT))"
_TEXT = ", ".join([_said(n, c) for n, c in (("Severity", "severity_label"), ("Faber", "faber_signal"), ("Stage", "stage"), ("RRG", "quadrant"), ("RRG-M", "quadrant_m"))] + [
    f"CASE WHEN abs(rs_pct_composite_delta) >= 5 THEN 'RS: ' || CAST(rs_pct_composite_prev AS BIGINT) || '→' || CAST(rs_pct_composite AS BIGINT) || ' (' || {_signed('rs_pct_composite_delta')} || ')' END",
    f"CASE WHEN abs(minervini_count_delta) >= 1 THEN 'Minervini: ' || minervini_count_prev || '→' || minervini_count || '/7 (' || {_signed('minervini_count_delta')} || ')' END",
])
part("changed", f"SELECT *, coalesce(nullif(concat_ws('  |  ', {_TEXT}), ''), 'score change only') AS change_summary, '1998-12-31' AS curr_date, '1998-06-30' AS prev_date, CAST(row_number() OVER (ORDER BY severity_score_delta DESC NULLS LAST, industry_key) AS INTEGER) AS rank FROM cmp2 WHERE any_change AND NOT is_new AND NOT is_dropped")
_con = lambda c: f"(contains({c}, 'Confirmed') AND NOT contains({c}, 'Exit'))"
_CROSS = {
    "new STRONG BUY": "faber_signal = 'STRONG BUY' AND faber_signal_prev <> 'STRONG BUY'", "lost STRONG BUY": "faber_signal <> 'STRONG BUY' AND faber_signal_prev = 'STRONG BUY'",
    "new stage 2": "stage IN ('2A', '2B') AND stage_prev NOT IN ('2A', '2B')", "dropped to stage 3/4": "stage IN ('3', '4') AND stage_prev NOT IN ('3', '4')",
    "new Confirmed": f"{_con('severity_label')} AND NOT {_con('severity_label_prev')}", "lost Confirmed": f"NOT {_con('severity_label')} AND {_con('severity_label_prev')}",
}
FINAL |= {
    "signal_delta": "SELECT * FROM changed",
    "signal_crossings": " UNION ALL ".join(f"SELECT industry_key, '{k}' AS crossing FROM cmp2 WHERE NOT is_new AND NOT is_dropped AND {c}" for k, c in _CROSS.items()),
    "largest_moves": "SELECT *, CAST(row_number() OVER (PARTITION BY direction ORDER BY abs(coalesce(severity_score_delta, 0)) DESC, industry_key) AS INTEGER) AS place FROM (SELECT industry_key, severity_score_delta, CASE WHEN severity_score_delta > 0 THEN 'upgrade' WHEN severity_score_delta < 0 THEN 'downgrade' ELSE 'lateral' END AS direction FROM changed) QUALIFY place <= 3",
    "full_template": "SELECT industry_key, stage, minervini_count FROM stages WHERE stage = '2B' AND minervini_count = 7",
    "filtered_severity": "SELECT industry_key, severity_label, faber_signal FROM sev WHERE faber_signal IN ('HOLD', 'CAUTION', 'EXIT') AND trim(regexp_replace(severity_label, '\\s*[\\(★].*$', '')) IN ('Neutral / Watch', 'Weakening', 'Early Signal', 'Confirmed')",
    "latest_week_top": "SELECT industry_key, date, sctr, rs_ratio FROM hist WHERE date = (SELECT max(date) FROM hist) AND sctr IS NOT NULL ORDER BY sctr DESC, industry_key LIMIT 10",
}
# -- files -----------------------------------------------------------------------------------------------------------

_FILE = "symbol, date, open, high, low, close, volume"
FINAL |= {
    "bar_file_reader": f"SELECT {_FILE}, market_cap FROM bars LEFT JOIN caps USING (symbol)",
    "batch_file_reader": f"SELECT {_FILE} FROM bars WHERE date > '1997-06-30'",
    "clean_closes": "SELECT symbol, date, close FROM all_bars",
    "universe_file": "SELECT * FROM universe WHERE group_name IN ('large', 'mid')",
    "ranged_slice": f"SELECT {BAR} FROM all_bars WHERE date BETWEEN '1996-01-01' AND '1996-12-31' AND high > low",
    "score_buckets_on_disk": "SELECT cap_bucket, count(*) AS n FROM stock_scores GROUP BY ALL",
    "history_on_disk": "SELECT industry_key, date, sctr, rs_ratio, rs_momentum FROM hist",
    "last_caps": "SELECT * FROM caps",
}
# -- the same with filters that reject rows --------------------------------------------------------------------------

for _name in ("scr1", "scr2"):
    part(f"buy_{_name}", re.sub(r"\bscr1\b", "buy_scr1", PARTS[_name]).replace("('STRONG BUY', 'BUY', 'HOLD', 'WATCH', 'CAUTION', 'EXIT')", "('STRONG BUY', 'BUY')").replace("minervini_count >= 1", "minervini_count >= 3"))
FINAL |= {
    "leaders_by_score": "SELECT * FROM ldn WHERE leader_score >= 3",
    "ranked_correction_leaders": FINAL["correction_leaders"] + " AND sctr >= 60",
    "buy_screen": PARTS["screen"].replace("scr2", "buy_scr2"),
}
# -- index on the dates of all stocks --------------------------------------------------------------------------------

part("uni_dates", "SELECT DISTINCT date FROM bars")
part("uni_f", "SELECT w.industry_key, w.symbol, g.date, w.weight, last_value(b.close IGNORE NULLS) OVER (PARTITION BY w.industry_key, w.symbol ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS close FROM idx_w w CROSS JOIN uni_dates g LEFT JOIN bars b ON b.symbol = w.symbol AND b.date = g.date")
for _new, _old in (("uni_r", "idx_r"), ("uni", "idx")):
    part(_new, PARTS[_old].replace("idx_", "uni_"))
FINAL["synthetic_on_all_dates"] = f"SELECT industry_key, date, {r('close', 4)} AS close, members FROM uni"
