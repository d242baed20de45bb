"""Stay points (W10) of a stream of fixes, whose rows may come late and in any order up to the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import grid_cell

FIX = "us long, lat double, lng double, cell string"
STAY = "cell string, first long, last long, lat double, lng double, n long"


class _Stays(StatefulProcessor):
    """Fixes wait in a buffer until the watermark has passed them; then they extend or close the stay that is open.

    A stay is closed by a fix of another cell, by one after a longer gap, or by the watermark alone once no fix that
    can still come is near enough. Rows at or below the watermark have all been seen, so the order is that of the batch.
    """

    def __init__(self, gap_us: int, least_us: int):
        self.gap_us, self.least_us = gap_us, least_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", FIX)
        self.stay = handle.getValueState("stay", STAY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        more = [tuple(r) for df in rows for r in df[["us", "lat", "lng", "cell"]].itertuples(index=False)]
        return self._advance(key, more, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, key, more: list, watermark_ms: int) -> Iterator[pd.DataFrame]:
        seen = watermark_ms * 1000
        waiting = sorted([tuple(x) for x in self.buffer.get()] + [(int(u), float(a), float(b), str(c)) for u, a, b, c in more])
        ready = [x for x in waiting if x[0] <= seen]
        waiting = waiting[len(ready) :]
        now, out = self.stay.get(), []
        now = tuple(now) if now else None
        for us, lat, lng, cell in ready:
            if now and (cell != now[0] or us - now[2] > self.gap_us):
                out.append(now)
                now = None
            now = (*now[:2], us, *now[3:5], now[5] + 1) if now else (cell, us, us, lat, lng, 1)
        if now and seen - now[2] > self.gap_us and not (waiting and waiting[0][0] - now[2] <= self.gap_us):
            out.append(now)
            now = None
        self.buffer.put(waiting) if waiting else self.buffer.clear()
        self.stay.update(now) if now else self.stay.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [x for x in ([waiting[0][0]] if waiting else []) + ([now[2] + self.gap_us + 1000] if now else [])]
        if due:
            self.handle.registerTimer(max(min(due) // 1000 + 1, watermark_ms + 1))
        done = [(*key, *s) for s in out if s[2] - s[1] >= self.least_us]
        yield pd.DataFrame(done, columns=["key", "cell", "first", "last", "lat", "lng", "n"])


def stay_points(stream: DataFrame, key: str, ts: str, lat: str, lng: str, gap_h: float = 3, least_s: int = 300, step: float = 0.01, late: str = "1 hour") -> DataFrame:
    """W10 as a stream: (key, cell, start_time, end_time, lat, lng, n). Needs the RocksDB state store."""
    cell = F.concat_ws("_", grid_cell(lat, step), grid_cell(lng, step))
    x = stream.withWatermark(ts, late).select(F.col(key), F.col(ts), F.unix_micros(ts).alias("us"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"), cell.alias("cell"))
    kind = stream.schema[key].dataType.simpleString()
    out = x.groupBy(key).transformWithStateInPandas(_Stays(int(gap_h * 3600e6), int(least_s * 1e6)), f"key {kind}, cell string, first long, last long, lat double, lng double, n long", "Append", "EventTime")
    return out.select(F.col("key").alias(key), "cell", F.timestamp_micros("first").alias("start_time"), F.timestamp_micros("last").alias("end_time"), "lat", "lng", "n")
