"""Market clock: a regime state machine over index bars, with its event days."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.columns import np_round
from orrery.operators.bars import last_rows

# The names of the states.
CORRECTION, RALLY, UPTREND, PRESSURE, STRESS = "Correction", "Rally Attempt", "Confirmed Uptrend", "Uptrend Under Pressure", "Uptrend Under Stress"
UP = (UPTREND, PRESSURE, STRESS)


@dataclass(frozen=True)
class Limits:
    """Thresholds of the clock: percent changes, volume ratios, sessions. The defaults are fixed values."""

    ftd_gain: float = 1.25
    ftd_day: int = 4
    dd_drop: float = -0.20
    window: int = 25
    pressure: int = 5
    stress: int = 6
    stall_gain: float = 0.40
    stall_volume: float = 1.50
    correction_drop: float = 7.0


@dataclass
class Clock:
    """State between two bars: everything that the next bar needs."""

    state: str = CORRECTION
    rally_day: int = 0
    rally_low: float | None = None
    last_close: float | None = None
    last_volume: float | None = None
    last_date: str = ""
    flags: list[int] = field(default_factory=list)
    closes: list[float] = field(default_factory=list)

    def bar(self, date: str, low: float, close: float, volume: float, limits: Limits) -> dict:
        """Take the next bar; what happened on it."""
        first = self.last_close is None
        pct = None if first or not self.last_close else (close / self.last_close - 1) * 100
        ratio = None if first or not self.last_volume else volume / self.last_volume
        # any volume after none counts as more volume; the ratio itself is not known
        more = not first and self.last_volume == 0 and volume > 0
        v, was, kind, day = float("inf") if more else 1.0 if ratio is None else ratio, self.state, "", 0
        change = float("nan") if pct is None else pct
        if was in UP and change <= limits.dd_drop and v > 1.0:
            kind = "Distribution"
        elif was in UP and 0.0 <= change <= limits.stall_gain and v >= limits.stall_volume:
            kind = "Stall"
        self.flags = [*self.flags, int(kind != "")][-limits.window :]
        self.closes = [*self.closes, close][-limits.window :]
        if first:
            pass
        elif was == CORRECTION:
            if change > 0:
                self.state, self.rally_day, self.rally_low = RALLY, 1, low
        elif was == RALLY:
            if close < self.rally_low:
                self.state, self.rally_day, self.rally_low = CORRECTION, 0, None
            else:
                self.rally_day += 1
                if self.rally_day >= limits.ftd_day and change >= limits.ftd_gain and v > 1.0:
                    kind, day = "Follow-Through", self.rally_day
                    self.state, self.rally_day, self.rally_low = UPTREND, 0, None
        else:
            count = sum(self.flags)
            self.state = STRESS if count >= limits.stress else PRESSURE if count >= limits.pressure else UPTREND
            if close < max(self.closes) * (1 - limits.correction_drop / 100):
                self.state, self.rally_day, self.rally_low = CORRECTION, 0, None
        self.last_close, self.last_volume, self.last_date = close, volume, date
        return {"pct_chg": pct, "vol_ratio": ratio, "state": self.state, "rally_day": self.rally_day, "rally_day1_low": self.rally_low, "event": kind or None, "event_day": day or None, "dd_count": sum(self.flags)}


TRACE = "pct_chg double, vol_ratio double, state string, rally_day int, rally_day1_low double, event string, event_day int, dd_count int"


def trace(bars: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(symbol, date, close, state, ...) of every bar. The state depends on all bars before, so a symbol's rows are
    folded in order by one task; symbols run side by side."""
    own = asdict(limits or Limits())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date").reset_index(drop=True)
        clock, lim = Clock(), Limits(**own)
        out = [clock.bar(str(d), low, close, volume, lim) for d, low, close, volume in zip(rows["date"], rows["low"], rows["close"], rows["volume"], strict=True)]
        found = pd.DataFrame(out)
        for c in ("rally_day", "event_day", "dd_count"):
            found[c] = found[c].astype("Int32")
        return pd.concat([rows[["symbol", "date", "close"]], found], axis=1)

    return bars.select("symbol", "date", "low", "close", "volume").groupBy("symbol").applyInPandas(run, f"symbol string, date date, close double, {TRACE}")


STATE = "state string, rally_day int, rally_low double, last_close double, last_volume double, last_date string, flags array<int>, closes array<double>"


def states(bars: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(symbol, state, ...) after the last bar of each index: what the clock has to know to go on from there."""
    own = asdict(limits or Limits())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, clock, lim = rows.sort_values("date"), Clock(), Limits(**own)
        for d, low, close, volume in zip(rows["date"], rows["low"], rows["close"], rows["volume"], strict=True):
            clock.bar(str(d), low, close, volume, lim)
        return pd.DataFrame([{"symbol": rows["symbol"].iloc[0]} | asdict(clock)])

    return bars.select("symbol", "date", "low", "close", "volume").groupBy("symbol").applyInPandas(run, f"symbol string, {STATE}")


def events(traced: DataFrame) -> DataFrame:
    """One row an event day, with severity of distribution and quality of follow-through days."""
    p, v = F.abs("pct_chg"), F.col("vol_ratio")
    grade = (
        F.when(F.col("event") == "Stall", "Mild")
        .when((F.col("event") == "Distribution") & (p >= 1.0) & (v >= 1.4), "Severe")
        .when((F.col("event") == "Distribution") & (p >= 0.5) & (v >= 1.3), "Moderate")
        .when(F.col("event") == "Distribution", "Mild")
        .when((p >= 2.0) & (v >= 1.5), "Strong")
        .when(p >= 1.5, "Good")
        .otherwise("Weak")
    )
    return traced.where("event is not null").select("symbol", "date", F.col("event").alias("type"), np_round(F.col("pct_chg"), 2).alias("pct_chg"), np_round(v, 2).alias("vol_ratio"), np_round(F.col("close"), 2).alias("close"), grade.alias("grade"), "event_day")


def market_clock(bars: DataFrame, symbols: list[str] | None = None, rows: int = 300, min_rows: int = 50, limits: Limits | None = None) -> DataFrame:
    """State of each index at its last bar, from its last ``rows`` bars (cut to the as-of date before)."""
    own = bars if symbols is None else bars.where(F.col("symbol").isin(*symbols))
    cut = last_rows(own, ["symbol"], rows)
    cut = cut.withColumn("_rows", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("_rows") >= min_rows)
    traced = trace(cut, limits)
    ftd = F.when(F.col("event") == "Follow-Through", F.struct("date", "pct_chg", "vol_ratio", "event_day"))
    ends = traced.groupBy("symbol").agg(F.max_by(F.struct("date", "close", "state", "rally_day", "dd_count"), "date").alias("e"), F.max(ftd).alias("f"))
    shown = F.when((F.col("e.state") == RALLY) & (F.col("e.rally_day") > 0), F.concat_ws(" ", "e.state", F.col("e.rally_day").cast("string"))).otherwise(F.col("e.state"))
    return ends.select(
        F.col("symbol").alias("ticker"), F.col("e.date").alias("as_of_date"), F.col("e.close").alias("close"), shown.alias("state"), F.col("e.rally_day").alias("rally_day"), F.col("e.dd_count").alias("dd_count_25d"),
        (F.col("e.dd_count") >= (limits or Limits()).pressure).alias("dd_under_pressure"), F.col("f.date").alias("last_ftd_date"), np_round(F.col("f.pct_chg"), 2).alias("last_ftd_gain_pct"), np_round(F.col("f.vol_ratio"), 2).alias("last_ftd_vol_ratio"), F.col("f.event_day").alias("last_ftd_day"),
    )


def event_lists(traced: DataFrame) -> DataFrame:
    """Event days of each symbol as arrays, newest first."""
    e = F.struct("date", "pct_chg", "vol_ratio", "close", "grade", "event_day")
    kinds = {"follow_through_days": "Follow-Through", "distribution_days": "Distribution", "stall_days": "Stall"}
    return events(traced).groupBy("symbol").agg(*(F.sort_array(F.collect_list(F.when(F.col("type") == kind, e)), asc=False).alias(name) for name, kind in kinds.items()))
