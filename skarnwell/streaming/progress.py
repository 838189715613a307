"""What running streams report."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last report of every stream by its id, and drops it when the stream ends. Add it with spark.streams.addListener."""

    def __init__(self):
        self.active: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.active[str(event.id)] = {"name": event.name, "batch": -1, "rows": 0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        known = self.active.setdefault(str(p.id), {"name": p.name, "batch": -1, "rows": 0})
        known |= {"batch": p.batchId, "rows": known["rows"] + p.numInputRows}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.active.pop(str(event.id), None)
