"""Incidents opened and recovered as a stream, whatever the order in which evaluations arrive.

An evaluation (tenant_id, subject, type, event_id, at, violating) waits in the state of its key until the watermark has passed
it, which a timer says; then what waited is taken in the order of time and id. So the stream gives what ``transitions`` gives
for the whole history, for all evaluations that are not later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEYS = ["tenant_id", "subject", "type"]
TRANSITIONS = "tenant_id string, subject string, type string, transition string, event_id string, at timestamp, first_event string, version long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def transitions(evaluations: DataFrame) -> DataFrame:
    """``TRANSITIONS`` of a history: an incident opens with the first violating evaluation of its key and recovers with the
    first one after it that does not violate. ``version`` counts its violating evaluations up to then."""
    rows = evaluations.filter("violating is not null and at is not null").select(*KEYS, "event_id", "at", "violating").dropDuplicates([*KEYS, "event_id"])
    order = W.partitionBy(*KEYS).orderBy("at", "event_id")
    # an incident is a row of violating evaluations: all with the same number of good ones before them
    df = rows.withColumn("_good", F.count_if(~F.col("violating")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    df = df.withColumn("_spell", F.when(F.col("violating"), F.col("_good")).otherwise(F.col("_good") - 1))
    spell = W.partitionBy(*KEYS, "_spell").orderBy("at", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumns({"version": F.count_if("violating").over(spell), "first_event": F.first(F.when(F.col("violating"), F.col("event_id")), ignorenulls=True).over(spell)})
    opened = F.col("violating") & (F.col("version") == 1)
    return df.filter(opened | (~F.col("violating") & (F.col("version") > 0))).select(*KEYS, F.when(F.col("violating"), F.lit("opened")).otherwise(F.lit("recovered")).alias("transition"), "event_id", "at", "first_event", "version")


class Lifecycle(StatefulProcessor):
    """State of a key: evaluations that wait, ids already seen among them, and the open incident."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_id string", "at long, violating boolean")
        self.open = handle.getValueState("open", "first_event string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for i, at, bad in zip(batch["event_id"], batch["at"], batch["violating"], strict=True):
                if pd.isna(at) or bad is None or pd.isna(bad) or self.waiting.containsKey((i,)):
                    continue
                ms = int(at.value // 1_000_000)
                self.waiting.updateValue((i,), (int(at.value // 1000), bool(bad)))
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((at, i[0], bad) for i, (at, bad) in self.waiting.iterator() if at // 1000 <= upto)
        now = self.open.get() if self.open.exists() else None
        out = []
        for at, i, bad in due:
            self.waiting.removeKey((i,))
            when = pd.Timestamp(at * 1000)
            if bad:
                now = (now[0], now[1] + 1) if now else (i, 1)
                if now[1] == 1:
                    out.append((*key, "opened", i, when, *now))
            elif now:
                out.append((*key, "recovered", i, when, *now))
                now = None
        if now:
            self.open.update(tuple(now))
        elif self.open.exists():
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])

    def close(self) -> None:
        pass


def transition_stream(evaluations: DataFrame, late: str = "1 hour") -> DataFrame:
    """The stream of ``TRANSITIONS``; the session's state store has to be ``PROVIDER``."""
    rows = evaluations.select(*KEYS, "event_id", "at", "violating").withWatermark("at", late)
    return rows.groupBy(*KEYS).transformWithStateInPandas(statefulProcessor=Lifecycle(), outputStructType=TRANSITIONS, outputMode="append", timeMode="EventTime")
