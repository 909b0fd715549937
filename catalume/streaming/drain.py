"""The drain monitor with keyed state and timers, and its batch form.

Each server's samples are judged in order of time over the window that trails every one of
them: the run is done when nothing is left, and it has come to a plateau when the slope stays
flat over a whole window. Either ends the server's run, once; later samples of it count no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "server string, at timestamp, total long, open long, slope double, span_hours double, status string"


def drain(samples: DataFrame, hours: float = 6.0, flat_per_day: float = 1.0) -> DataFrame:
    """``OUT`` for ``samples(server, ts, total, open)``, ``open`` being what isn't recognised yet.

    One row for every sample up to the one that ends a server's run. ``slope`` is the change of ``open``
    per second by least squares over the trailing window, null with fewer than two times. Samples
    without ``open`` have a row, but no part in slopes. Samples of one time stand in order of their numbers.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = samples.where("server is not null and ts is not null").withColumn("us", micros)
    rows = rows.withColumn("x", (F.col("us") - F.min("us").over(Window.partitionBy("server"))) / 1e6)
    trailing = Window.partitionBy("server").orderBy("us").rangeBetween(-round(hours * 3.6e9), 0)
    known = F.col("open").isNotNull()
    fit = F.regr_slope(F.col("open").cast("double"), F.when(known, F.col("x"))).over(trailing)
    first, last = F.min(F.when(known, F.col("us"))).over(trailing), F.max(F.when(known, F.col("us"))).over(trailing)
    rows = rows.withColumn("slope", F.when(last > first, fit)).withColumn("span_hours", F.when(last > first, (last - first) / 3.6e9))
    status = F.when((F.col("total") == 0) | (F.coalesce("open", F.lit(-1)) == 0), "done")
    status = status.when((F.col("span_hours") >= hours) & (F.abs("slope") * 86400 < flat_per_day), "plateau").otherwise("running")
    order = Window.partitionBy("server").orderBy("us", "total", "open")
    rows = rows.withColumn("status", status)
    ended = F.coalesce(F.max(F.col("status") != "running").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("ended", ended).where("not ended").select("server", F.col("ts").alias("at"), "total", "open", "slope", "span_hours", "status")


class _Monitor(StatefulProcessor):
    """Samples wait until the watermark has passed them; a timer at each one's time then judges them in order."""

    def __init__(self, hours: float, flat_per_day: float) -> None:
        self.hours, self.flat = hours, flat_per_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "us long, total long, open long, judged boolean")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.ended.exists():
            for part in rows:
                for ts, total, left in zip(part["ts"], part["total"], part["open"], strict=True):
                    us = pd.Timestamp(ts).value // 1000
                    self.samples.appendValue((us, None if pd.isna(total) else int(total), None if pd.isna(left) else int(left), False))
                    self.handle.registerTimer(us // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(self.samples.get(), key=lambda s: (s[0], s[1] is not None, s[1] or 0, s[2] is not None, s[2] or 0)) if not self.ended.exists() else []
        keep, out, window = [], [], round(self.hours * 3.6e9)
        finished = False
        for us, total, left, judged in held:
            if judged or us // 1000 > due:
                continue
            pts = [(u, o) for u, _, o, _ in held if us - window <= u <= us and o is not None]
            slope, span = _fit(pts)
            status = "running"
            if total == 0 or left == 0:
                status = "done"
            elif span is not None and span >= self.hours and abs(slope) * 86400 < self.flat:
                status = "plateau"
            out.append((key[0], pd.Timestamp(us * 1000), total, left, slope, span, status))
            if status != "running":
                finished = True
                break
        if finished:
            self.ended.update((True,))
            self.samples.clear()
        elif held:
            # what no later sample's window can reach is forgotten
            low = due * 1000 - window
            keep = [(us, total, left, judged or us // 1000 <= due) for us, total, left, judged in held if us >= low or us // 1000 > due]
            self.samples.clear()
            if keep:
                self.samples.put(keep)
        if out:
            frame = pd.DataFrame(out, columns=["server", "at", "total", "open", "slope", "span_hours", "status"])
            yield frame.astype({"total": "Int64", "open": "Int64", "slope": "float64", "span_hours": "float64"})

    def close(self) -> None:
        pass


def _fit(points: list[tuple[int, int]]) -> tuple[float | None, float | None]:
    """Slope per second and span in hours of (microseconds, value) points in order of time."""
    if len(points) < 2 or points[0][0] == points[-1][0]:
        return None, None
    x, y = [(u - points[0][0]) / 1e6 for u, _ in points], [float(v) for _, v in points]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)
    return slope, (points[-1][0] - points[0][0]) / 3.6e9


def stream_drain_monitor(samples: DataFrame, hours: float = 6.0, flat_per_day: float = 1.0, lateness: str = "1 hour") -> DataFrame:
    """The same rows from a stream of samples, each once the watermark has passed it.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). State of a server is
    its samples of one window, and a mark once its run has ended.
    """
    keyed = samples.where("server is not null and ts is not null").withWatermark("ts", lateness).groupBy("server")
    return keyed.transformWithStateInPandas(_Monitor(hours, flat_per_day), OUT, "Append", "EventTime")
