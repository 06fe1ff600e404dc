"""Progress of streams, told every few triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Calls `tell` with run, batch, rows and rows a second of every `every`-th trigger that had rows. Register it by spark.streams.addListener."""

    def __init__(self, tell: Callable[[dict], None], every: int = 1):
        self.tell, self.every, self.seen = tell, max(1, every), 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.seen += 1
            if self.seen % self.every == 0:
                self.tell({"run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "rows_s": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
