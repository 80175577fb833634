"""The controller of agents as a keyed stream: a state a key in the state store, early rows in order, gaps skipped by a timer.

An agent's observations are numbered from 1. Those that come early wait in the state until the ones before them are there;
if a gap stays open until the watermark has passed it by ``patience``, a timer gives it up and the agent goes on with the next
number. A number that was passed already is not told again, so replayed rows change nothing. The steps are those of the
batch fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronofold.operators.states import control_step, shown

TOLD = "agent long, seq long, ema string, mode string, trigger string, stagnation int"


class Controller(StatefulProcessor):
    """Steps of one agent's average, mode and stagnation."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "seq long, ema long, mode string, still int")
        self.early = handle.getMapState("early", "seq long", "units long, at_ms long")

    def _steps(self, agent: int, skip: bool) -> Iterator[tuple]:
        """The steps that can be taken now; with ``skip`` the numbers up to the first that waits are given up."""
        seq, ema, mode, still = self.state.get() if self.state.exists() else (0, 0, "ROAMING", 0)
        if skip and self.early.exists():
            seq = min(k[0] for k in self.early.keys()) - 1  # noqa: SIM118
        while self.early.containsKey((seq + 1,)):
            units = self.early.getValue((seq + 1,))[0]
            self.early.removeKey((seq + 1,))
            seq += 1
            (ema, mode, still), trigger = control_step((ema, mode, still), units)
            yield agent, seq, shown(ema), mode, trigger, still
        self.state.update((seq, ema, mode, still))

    def _waiting(self) -> None:
        """One timer while a gap is open: for the first row that waits behind it."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        first = min(((k[0], v[1]) for k, v in self.early.iterator()), default=None)
        if first:
            self.handle.registerTimer(first[1] + self.patience_ms)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["agent", "seq", "ema", "mode", "trigger", "stagnation"]).astype({"agent": "int64", "seq": "int64", "stagnation": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self.state.get()[0] if self.state.exists() else 0
        for frame in rows:
            at_ms = (frame["at"].astype("datetime64[ms]").astype("int64")).tolist()
            for seq, units, at in zip(frame["seq"].tolist(), frame["units"].tolist(), at_ms, strict=True):
                if seq > done:
                    self.early.updateValue((seq,), (units, at))
        told = list(self._steps(int(key[0]), False))
        self._waiting()
        yield self._frame(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = list(self._steps(int(key[0]), True))
        self._waiting()
        yield self._frame(told)

    def close(self) -> None:
        pass


def controlled(observations: DataFrame, patience_ms: int = 600_000, lateness: str = "10 minutes") -> DataFrame:
    """The steps of a stream of observations (agent, seq from 1, units of 1e-10, at), as the batch fold tells them.

    The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = observations.select("agent", "seq", "units", "at").withWatermark("at", lateness).groupBy("agent")
    return keyed.transformWithStateInPandas(Controller(patience_ms), TOLD, "Append", "EventTime")
