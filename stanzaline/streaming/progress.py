"""Check-ins as keyed state: what a plan has of days is kept with the plan, not read from a log.

A check-in is known by its plan and day; a later one of a day replaces an earlier one, so batches that come
again, twice or in another order leave the state as one pass over all of them would. Of a batch each task sends the
last check-in of every plan and day alone, so that the state is touched for days and not for check-ins, however many
a plan has. Each batch gives a row for every plan that it changed. A plan is closed by a timer when the watermark passes its end: its last row says so
and its state goes, so the state holds running plans alone.

Defined cases: rows with a null in plan, day or time are no check-ins, nor are days outside the plan; check-ins
of a day at one time are told apart by their number, the largest wins; a check-in that comes after its plan is
closed, or behind the watermark, is dropped as late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PLAN_DAYS = 365
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "plan_id long, done long, percent double, last_day long, closed boolean"


#: Rows that ``_latest`` holds at most.
_HELD = 1 << 16


def _last(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["at_us", "n"]).drop_duplicates(["plan_id", "day"], keep="last")


def _latest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last check-in of every plan and day that a task sees; of one it may send several where they are very many."""
    held = None
    for batch in batches:
        held = _last(batch if held is None else pd.concat([held, batch]))
        if len(held) > _HELD:
            yield held
            held = None
    if held is not None:
        yield held


class Progress(StatefulProcessor):
    """Days of a plan with their last check-in; ``ends_ms`` is when plans end, on the clock of the check-ins."""

    def __init__(self, days: int = PLAN_DAYS, ends_ms: int | None = None):
        self.days, self.ends_ms = days, ends_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "day long", "at_us long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed = False
        for batch in rows:
            batch = batch.sort_values(["at_us", "n"]).drop_duplicates("day", keep="last")
            for day, at, n in zip(batch["day"], batch["at_us"], batch["n"]):
                known = self.seen.getValue((int(day),)) if self.seen.containsKey((int(day),)) else None
                if known is None or (int(at), int(n)) > tuple(known):
                    self.seen.updateValue((int(day),), (int(at), int(n)))
                    changed = True
        if changed:
            if self.ends_ms is not None:
                self.handle.registerTimer(self.ends_ms)  # one that is there already stays one
            yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, True)
        self.seen.clear()

    def _row(self, key, closed: bool) -> pd.DataFrame:
        days = [d for (d,) in self.seen.keys()]
        return pd.DataFrame({"plan_id": [key[0]], "done": [len(days)], "percent": [round(100.0 * len(days) / self.days, 1)], "last_day": [max(days, default=0)], "closed": [closed]})

    def close(self) -> None:
        pass


def track(checkins: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, late: str = "400 days", days: int = PLAN_DAYS, ends_ms: int | None = None) -> StreamingQuery:
    """Start a stream of check-ins (plan_id, day, at, n); ``write`` gets the changed plans of each batch and its number.

    ``write`` may get a batch again after a restart and must then replace what it wrote of it.
    """
    spark = checkins.sparkSession
    own = checkins.withColumn("at", F.col("at").cast("timestamp")).where(F.col("plan_id").isNotNull() & F.col("at").isNotNull() & F.col("day").between(1, days))
    own = own.select(F.col("plan_id").cast("long").alias("plan_id"), F.col("day").cast("long").alias("day"), F.unix_micros("at").alias("at_us"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))
    # where the last check-in of a day is late, all of them are
    own = own.mapInPandas(_latest, "plan_id long, day long, at_us long, n long")
    own = own.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    mode = "None" if ends_ms is None else "EventTime"
    changed = own.groupBy("plan_id").transformWithStateInPandas(Progress(days, ends_ms), SCHEMA, "Update", mode)
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)


def keep(path: str) -> Callable[[DataFrame, int], None]:
    """A writer of batches to folders by their number, so that a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(batches: DataFrame) -> DataFrame:
    """Each plan's last row of the batches that ``keep`` wrote."""
    columns = [c for c in batches.columns if c not in ("plan_id", "batch")]
    last = batches.groupBy("plan_id").agg(F.max_by(F.struct(*columns), F.struct("batch", "closed")).alias("last"))
    return last.select("plan_id", "last.*")
