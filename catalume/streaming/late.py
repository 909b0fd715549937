"""How many rows came too late for a stream, read from its progress by a listener."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Rows read, and rows dropped behind the watermark, of each query by name.

    ``read`` comes from the ``observe`` metric that :func:`observed` adds to a stream, ``late`` from the
    stateful operators, which drop late rows. Register it with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self.read: dict[str, int] = defaultdict(int)
        self.late: dict[str, int] = defaultdict(int)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        name = progress.name or str(progress.id)
        metrics = progress.observedMetrics.get("rows")
        if metrics is not None:
            self.read[name] += metrics["n"]
        self.late[name] += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass


def observed(stream: DataFrame) -> DataFrame:
    """The stream, with its rows counted by ``observe`` under the name ``rows``."""
    return stream.observe("rows", F.count(F.lit(1)).alias("n"))
