"""Progress of indexing by workspace: partial updates merged into one snapshot, fed by calls and by a stream's own reports."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: What a workspace that has reported nothing is at.
IDLE = {"indexing": False, "phase": "idle", "filesDone": 0, "filesTotal": 0, "nodesWritten": 0, "edgesWritten": 0}


class Progress(StreamingQueryListener):
    """Snapshots by workspace. As a listener it takes the rows of each batch of queries named `index:<workspace>`."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._known: dict[str, dict] = {}

    def update(self, workspace: str, **partial) -> None:
        """Fields of a snapshot; the others stay."""
        with self._lock:
            self._known[workspace] = {**self._known.get(workspace, IDLE), **partial}

    def get(self, workspace: str) -> dict:
        with self._lock:
            return dict(self._known.get(workspace, IDLE))

    def clear(self, workspace: str) -> None:
        with self._lock:
            self._known.pop(workspace, None)

    def _workspace(self, name: str | None) -> str | None:
        return name.removeprefix("index:") if name and name.startswith("index:") else None

    def onQueryStarted(self, event) -> None:
        if workspace := self._workspace(event.name):
            self.update(workspace, **{**IDLE, "indexing": True, "phase": "starting"})
            with self._lock:
                self._runs = {**getattr(self, "_runs", {}), str(event.runId): workspace}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if workspace := self._workspace(p.name):
            before = self.get(workspace)
            self.update(workspace, phase="writing", filesDone=before["filesDone"] + max(0, p.numInputRows), **{k: v for k, v in (json.loads(p.json).get("observedMetrics", {}) or {}).get("index", {}).items() if k in IDLE})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if workspace := getattr(self, "_runs", {}).get(str(event.runId)):
            self.update(workspace, indexing=False, phase="failed" if event.exception else "done", **({"error": event.exception} if event.exception else {}))


def snapshots(updates: DataFrame) -> DataFrame:
    """updates(workspace, n, field, value) to (workspace, field, value): the last value by n of each field, or the idle one.

    The same merge over a log of updates, whatever its size.
    """
    last = updates.groupBy("workspace", "field").agg(F.max_by("value", "n").alias("value"))
    idle = updates.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in IDLE.items()], "field string, idle string")
    every = updates.select("workspace").distinct().join(F.broadcast(idle))  # a row for each of six fields
    return every.join(last, ["workspace", "field"], "full_outer").select("workspace", "field", F.coalesce("value", "idle").alias("value"))
