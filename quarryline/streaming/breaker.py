"""Quarantine of failing workspaces: three failed flushes in a row close a workspace for a minute, then one probe decides.

An attempt within the cooldown of an open breaker is skipped and changes nothing. The first one after it is a probe:
a failure opens the breaker for another cooldown, a success forgets all failures.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scan import carried

THRESHOLD, COOLDOWN = 3, 60


def step(streak: int, until, at, failed: bool, threshold: int, cooldown):
    """(streak, until, outcome) after an attempt; until is None while the breaker is closed."""
    if until is not None and at < until:
        return streak, until, "skipped"
    if not failed:
        return 0, None, "landed"
    streak += 1
    if streak < threshold:
        return streak, None, "failed"
    return streak, at + cooldown, "opened"


def outcomes(attempts: DataFrame, threshold: int = THRESHOLD, cooldown: int = COOLDOWN, block: int = 86_400) -> DataFrame:
    """attempts(workspace, id, at, failed) to (workspace, id, at, outcome, streak, until), outcome landed, failed, opened or skipped.

    `cooldown` and `block` are seconds. A success with no failed attempt in the cooldown before it lands whatever came
    earlier, and leaves no state. Such rows cut a workspace into segments, which are run apart, in order, two numbers of state each.
    A workspace that never has such a success is one segment. Attempts at one time are ordered by id.
    """
    rows = attempts.select("workspace", "id", "at", F.coalesce("failed", F.lit(False)).alias("failed"))
    span = F.floor(F.unix_timestamp("at") / block)
    rows = carried(rows, ["workspace"], span, ["at", "id"], F.when(F.col("failed"), F.col("at")), "_last", before=True)
    fresh = ~F.col("failed") & (F.col("_last").isNull() | (F.col("_last") + F.make_dt_interval(secs=F.lit(cooldown)) <= F.col("at")))
    rows = carried(rows, ["workspace"], span, ["at", "id"], F.when(fresh, F.struct("at", "id")), "_from")
    pause = timedelta(seconds=cooldown)

    def run(batches):
        of, streak, until = object(), 0, None
        for batch in batches:
            got = []
            for workspace, start, at, failed in zip(*(batch[c].to_pylist() for c in ("workspace", "_from", "at", "failed")), strict=True):
                if (workspace, start) != of:
                    of, streak, until = (workspace, start), 0, None
                streak, until, outcome = step(streak, until, at, failed, threshold, pause)
                got.append((outcome, streak, until))
            outcome, streaks, untils = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["workspace"], batch["id"], batch["at"], pa.array(outcome, pa.string()), pa.array(streaks, pa.int32()), pa.array(untils, batch["at"].type)], names=["workspace", "id", "at", "outcome", "streak", "until"])

    kind = dict(rows.dtypes)
    schema = f"workspace {kind['workspace']}, id {kind['id']}, at {kind['at']}, outcome string, streak int, until {kind['at']}"
    return rows.repartition("workspace", "_from").sortWithinPartitions("workspace", "_from", "at", "id").select("workspace", "_from", "id", "at", "failed").mapInArrow(run, schema)


class Breaker(StatefulProcessor):
    """The state of each workspace of a stream; a timer tells when its cooldown is over."""

    def __init__(self, threshold: int = THRESHOLD, cooldown: int = COOLDOWN):
        self.threshold, self.pause = threshold, timedelta(seconds=cooldown)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "streak int, until timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        streak, until = self.state.get() if self.state.exists() else (0, None)
        until = None if until is None else pd.Timestamp(until).tz_localize(None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples():
            streak, until, outcome = step(streak, until, r.at, bool(r.failed), self.threshold, self.pause)
            if outcome == "opened":
                self.handle.registerTimer(int(until.timestamp() * 1000))
            out.append((key[0], r.id, r.at, outcome, streak))
        if streak:
            self.state.update((streak, until))
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=["workspace", "id", "at", "outcome", "streak"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        streak = self.state.get()[0] if self.state.exists() else 0
        yield pd.DataFrame({"workspace": [key[0]], "id": [None], "at": [at], "outcome": ["half-open"], "streak": [streak]})

    def close(self) -> None:
        pass


def breaker(stream: DataFrame, threshold: int = THRESHOLD, cooldown: int = COOLDOWN, late: str = "10 seconds") -> DataFrame:
    """The same over a stream of attempts, with a row `half-open` when a cooldown is over by the watermark.

    A row that comes later than `late` behind its workspace's others is judged when it comes. Needs the RocksDB state store.
    """
    rows = stream.select(F.col("workspace").cast("string").alias("workspace"), F.col("id").cast("string").alias("id"), "at", "failed").withWatermark("at", late)
    return rows.groupBy("workspace").transformWithStateInPandas(Breaker(threshold, cooldown), "workspace string, id string, at timestamp, outcome string, streak int", "append", "eventtime")
