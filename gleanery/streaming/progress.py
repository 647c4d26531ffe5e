"""Progress counted on the way: metrics of the rows that pass, without a scan of its own."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: The name of the metrics.
NAME = "progress"


def counted(rows: DataFrame, embedding: str = "embedding", name: str = NAME) -> DataFrame:
    """rows, observed: rows and embedded (those with an embedding), counted as they are written."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.count(embedding).alias("embedded"))


def duration(seconds: float) -> str:
    """As functions.text.eta, of a number."""
    if seconds < 1:
        return "<1s"
    whole = int(seconds)
    hours, minutes = whole // 3600, whole % 3600 // 60
    if whole < 60:
        return f"{whole}s"
    if whole < 3600:
        return f"{minutes}m{whole % 60}s"
    return f"{hours}h{minutes}m" if minutes else f"{hours}h"


class Progress(StreamingQueryListener):
    """Listens to a stream whose rows are counted: what is done of a known total, and the time left at the pace so far.

    Add it with spark.streams.addListener. total: rows to embed in all.
    """

    def __init__(self, total: int, name: str = NAME) -> None:
        self.total, self.name = total, name
        self.rows = self.embedded = self.batches = 0
        self.seconds = 0.0
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001
        found = event.progress.observedMetrics.get(self.name)
        if found is None:
            return
        with self._lock:
            self.rows += found["rows"] or 0
            self.embedded += found["embedded"] or 0
            self.seconds += event.progress.batchDuration / 1000
            self.batches += 1

    def onQueryIdle(self, event) -> None:  # noqa: ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001
        pass

    @property
    def pending(self) -> int:
        return max(0, self.total - self.embedded)

    @property
    def eta(self) -> str:
        """Time left, as text; calculating... before anything is embedded."""
        with self._lock:
            return duration(self.pending * self.seconds / self.embedded) if self.embedded and self.seconds > 0 else "calculating..."
