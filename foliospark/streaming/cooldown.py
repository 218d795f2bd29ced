"""T4 as a stream: one number of state per provider, the end of its hold.

A provider's calls reach one task, which is what keyed state means; the task reads them a frame
at a time and holds no more than one. The batch replay in ``operators.router`` is the way for a
backlog of any size."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "provider string, call_id bigint, skipped boolean"


class HoldProcessor(StatefulProcessor):
    """Marks calls made while their provider was on hold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until_ms bigint")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else 0
        last = 0
        for calls in rows:
            calls = calls.sort_values(["ts_ms", "call_id"])
            skipped = []
            for ts, cooldown in zip(calls.ts_ms.tolist(), calls.cooldown.tolist()):
                held = until > ts
                skipped.append(held)
                if cooldown and not held:
                    until = ts + cooldown
                last = max(last, ts)
            yield pd.DataFrame({"provider": key[0], "call_id": calls.call_id, "skipped": skipped})
        if until > last:
            self.until.update((int(until),))
        else:
            self.until.clear()

    def close(self) -> None:
        pass


def mark_skipped(calls: DataFrame) -> DataFrame:
    """``calls`` streams (provider, call_id, ts_ms, cooldown); needs the RocksDB store.

    Calls are taken in the order of their frames, and by time within one; a late one is held
    against the hold that is known by then. A hold that is over leaves no state."""
    return calls.groupBy("provider").transformWithStateInPandas(
        statefulProcessor=HoldProcessor(), outputStructType=OUTPUT,
        outputMode="Append", timeMode="None",
    )
