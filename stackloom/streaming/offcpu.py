"""Off-CPU pairing over a stream of scheduler switches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stackloom.operators.offcpu import lanes

OUTPUT = "file string, pid long, kstack string, start long, delta long"
_SWITCH = "time long, ord long, is_out boolean, kstack string"


class Pairing(StatefulProcessor):
    """Per file, pid and, for idle tasks, cpu: the switches that still wait for their order, and the last switch if it was one out.

    Switches wait until the watermark has passed them, so those of a micro-batch and
    of the next ones may come in any order; what comes later than that is dropped by
    Spark.  A timer at the time of the earliest one lets them out.  A pid without an
    open switch leaves no state; an open one is forgotten `forget_ns` after it.
    """

    def __init__(self, forget_ns: int):
        self.forget_ns = forget_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _SWITCH)
        self.open = handle.getValueState("open", "start long, kstack string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for frame in rows for r in frame[["time", "ord", "out", "kstack"]].itertuples(index=False, name=None)]
        if not new:
            return
        self.waiting.appendList([(int(t), int(o), bool(out), k) for t, o, out, k in new])
        self._wake(min(int(t) for t, *_ in new), timerValues)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(((t, o, out, k) for t, o, out, k in self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] // 1_000_000 < passed]
        start, stack = self.open.get() if self.open.exists() else (None, None)
        found = []
        for t, _, out, k in ready:
            if not out and start is not None:
                found.append((key[0], key[1], stack, start, t - start))
            start, stack = (t, k) if out else (None, None)
        if start is not None and (start + self.forget_ns) // 1_000_000 < passed:
            start = None
        if start is None:
            self.open.clear()
        else:
            self.open.update((start, stack))
        rest = rows[len(ready) :]
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0], timerValues)
        else:
            self.waiting.clear()
            if start is not None:
                self._wake(start + self.forget_ns, timerValues)
        yield pd.DataFrame(found, columns=["file", "pid", "kstack", "start", "delta"])

    def _wake(self, ns: int, timers) -> None:
        # the timer fires when the watermark is behind it, and with it behind the switch
        self.handle.registerTimer(max(ns // 1_000_000, timers.getCurrentWatermarkInMs()) + 1)

    def close(self) -> None:
        pass


def pair_stream(switches: DataFrame, delay: str = "10 seconds", forget_ns: int = 3600 * 10**9) -> DataFrame:
    """switches (file, pid, time, ord, out, kstack[, cpu]) of a stream, times in nanoseconds: a row for each completed pair, append mode.

    A switch may come up to `delay` behind the latest one.  State is kept by the
    RocksDB provider, which the session must name.
    """
    timed = lanes(switches).withColumn("event_time", F.timestamp_micros(F.expr("time div 1000"))).withWatermark("event_time", delay)
    return timed.groupBy("file", "pid", "lane").transformWithStateInPandas(statefulProcessor=Pairing(forget_ns), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def fold_stream(samples: DataFrame) -> DataFrame:
    """Running counts of folded stacks (stack, weight) as recordings arrive; complete mode."""
    return samples.groupBy("stack").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "count")
