"""The market clock as a stateful stream: one state per index, bars in date order, late bars dropped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orrery.operators import clock
from orrery.operators.clock import TRACE, Clock, Limits
from orrery.sources.sinks import shared_path

OUTPUT = f"symbol string, date date, close double, {TRACE}"
#: The state store that typed states need.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class ClockProcessor(StatefulProcessor):
    """The clock of one index: its scalars as a value state, the flags and closes of its window as list states."""

    def __init__(self, limits: Limits) -> None:
        self.limits = asdict(limits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, rally_day int, rally_low double, last_close double, last_volume double, last_date string")
        self.flags = handle.getListState("flags", "flag int")
        self.closes = handle.getListState("closes", "close double")

    def _save(self, c: Clock) -> None:
        self.now.update((c.state, c.rally_day, c.rally_low, c.last_close, c.last_volume, c.last_date))
        self.flags.put([(int(x),) for x in c.flags])
        self.closes.put([(float(x),) for x in c.closes])

    def _load(self) -> Clock:
        if not self.now.exists():
            return Clock()
        return Clock(*self.now.get(), [x[0] for x in self.flags.get()], [x[0] for x in self.closes.get()])

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timer_values: object) -> None:
        row = initial.iloc[0]
        real = lambda x: None if pd.isna(x) else float(x)
        self._save(Clock(row["state"], int(row["rally_day"]), real(row["rally_low"]), real(row["last_close"]), real(row["last_volume"]), row["last_date"], list(row["flags"]), list(row["closes"])))

    def handleInputRows(self, key: tuple, batches: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        own, limits, out = self._load(), Limits(**self.limits), []
        rows = pd.concat(list(batches)).sort_values("date")
        for date, low, close, volume in zip(rows["date"], rows["low"], rows["close"], rows["volume"], strict=True):
            if str(date) > own.last_date:
                out.append({"symbol": key[0], "date": date, "close": close} | own.bar(str(date), low, close, volume, limits))
        self._save(own)
        if out:
            found = pd.DataFrame(out)
            for c in ("rally_day", "event_day", "dd_count"):
                found[c] = found[c].astype("Int32")
            yield found

    def close(self) -> None:
        pass


def clock_states(stream: DataFrame, limits: Limits | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The clock's trace of a stream of bars (symbol, date, low, close, volume). A bar not after the last one is dropped.

    ``initial``: states to start from (``clock.states`` of a history); it counts when a checkpoint is new. A batch of a symbol is
    sorted in memory, so it has to fit in a task. The session needs the settings in ``PROVIDER`` when the query starts.
    """
    picked = stream.select("symbol", "date", "low", "close", "volume")
    started = None if initial is None else initial.groupBy("symbol")
    return picked.groupBy("symbol").transformWithStateInPandas(ClockProcessor(limits or Limits()), OUTPUT, "Append", "None", started)


def start(traced: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run what has arrived and append it to a folder."""
    spark = traced.sparkSession
    before = {k: spark.conf.get(k, None) for k in PROVIDER}
    try:
        for k, v in PROVIDER.items():
            spark.conf.set(k, v)
        return traced.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replay(bars: DataFrame, cuts: tuple[str, str], limits: Limits | None = None) -> DataFrame:
    """The states of all bars: up to the first cut in one batch, which gives the stream its initial states, then from a stream
    that is stopped and started again from its checkpoint at the second one."""
    spark = bars.sparkSession
    incoming, out, checkpoint = (shared_path(spark, n) for n in ("bars", "clock", "clock-checkpoint"))
    history = bars.where(f"date < '{cuts[0]}'")
    initial = clock.states(history, limits)
    for part in (f"date >= '{cuts[0]}' and date < '{cuts[1]}'", f"date >= '{cuts[1]}'"):
        bars.where(part).write.mode("append").parquet(incoming)
        start(clock_states(spark.readStream.schema(bars.schema).parquet(incoming), limits, initial), out, checkpoint).awaitTermination()
    return clock.trace(history, limits).unionByName(spark.read.schema(OUTPUT).parquet(out))
