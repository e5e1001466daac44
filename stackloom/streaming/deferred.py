"""Deferred user chains joined to their samples over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "file string, ord long, callchain array<bigint>, seen_time long, seen_ord long"
_ROW = "time long, ord long, is_chain boolean, frames array<bigint>"


class Deferring(StatefulProcessor):
    """Per file and cookie: rows that still wait for their order, and samples that wait for a chain.

    Rows wait until the watermark has passed them.  A chain completes every sample of
    its cookie before it; a sample without one is forgotten `forget_ns` after it, as
    are samples without a chain in a batch.
    """

    def __init__(self, forget_ns: int):
        self.forget_ns = forget_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.samples = handle.getListState("samples", "time long, ord long, frames array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(o), bool(c), [int(x) for x in f]) for frame in rows for t, o, c, f in frame[["time", "ord", "is_chain", "frames"]].itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new), timerValues)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(((t, o, c, list(f)) for t, o, c, f in self.waiting.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] // 1_000_000 < passed]
        held = [(t, o, list(f)) for t, o, f in self.samples.get()]
        found = []
        for t, o, is_chain, frames in ready:
            if is_chain:
                found += [(key[0], so, [*own, *frames], t, o) for _, so, own in held]
                held = []
            else:
                held.append((t, o, frames))
        held = [h for h in held if (h[0] + self.forget_ns) // 1_000_000 >= passed]
        self._keep(self.samples, held)
        rest = rows[len(ready) :]
        self._keep(self.waiting, rest)
        if rest:
            self._wake(rest[0][0], timerValues)
        if held:
            self._wake(held[0][0] + self.forget_ns, timerValues)
        yield pd.DataFrame(found, columns=["file", "ord", "callchain", "seen_time", "seen_ord"])

    @staticmethod
    def _keep(state, rows: list) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _wake(self, ns: int, timerValues) -> None:
        self.handle.registerTimer(max(ns // 1_000_000, timerValues.getCurrentWatermarkInMs()) + 1)

    def close(self) -> None:
        pass


def rows_of(samples: DataFrame, deferred: DataFrame) -> DataFrame:
    """The rows of one stream: samples (file, ord, time, cookie, callchain) that have a cookie, and chains (file, ord, time, cookie, ips)."""
    empty = F.array().cast("array<bigint>")
    s = samples.filter("cookie is not null").select("file", "cookie", "time", "ord", F.lit(False).alias("is_chain"), F.coalesce("callchain", empty).alias("frames"))
    return s.unionByName(deferred.select("file", "cookie", "time", "ord", F.lit(True).alias("is_chain"), F.coalesce("ips", empty).alias("frames")))


def merge_stream(rows: DataFrame, delay: str = "10 seconds", forget_ns: int = 600 * 10**9) -> DataFrame:
    """rows as rows_of gives them, with times in nanoseconds: the whole chain of each sample, and where it was whole; append mode.

    Rows without a time cannot be put in order while they stream and are left out.
    State is kept by the RocksDB provider, which the session must name.
    """
    timed = rows.filter("time is not null").withColumn("event_time", F.timestamp_micros(F.expr("time div 1000"))).withWatermark("event_time", delay)
    return timed.groupBy("file", "cookie").transformWithStateInPandas(statefulProcessor=Deferring(forget_ns), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
