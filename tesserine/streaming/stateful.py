"""Keyed state over streams: drift alarms, recurrence triggers, incidents and bounded queues, each with its batch form.

A stream gives the rows of its batch form, whatever the cuts between its micro-batches
and after restarts from its checkpoint. Rows of a key are taken in the order of ``seq``
within a micro-batch; batches are expected in that order, as files of one source are.
State is kept per key and bounded: a window of outcomes, a count, two numbers, a queue.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """Keyed state of this kind needs the store that Spark ships with it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Keyed(StatefulProcessor):
    """One value state per key; subclasses turn a state and a row into the next state and the rows that are told."""

    state, start = "n long", (0,)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", self.state)

    def step(self, state: tuple, row: pd.Series) -> tuple[tuple, list[dict]]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = tuple(self.value.get()) if self.value.exists() else self.start
        told: list[dict] = []
        for row in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            at, more = self.step(at, row)
            told += [{"key": key[0], **m} for m in more]
        self.value.update(at)
        if told:
            yield pd.DataFrame(told)

    def close(self) -> None:
        pass


class DriftAlarm(_Keyed):
    """Tells when the share of failures in a full window passes the bound, once for each passing."""

    state, start = "outcomes string, above boolean", ("", False)

    def __init__(self, window: int, bound: float) -> None:
        self.window, self.bound = window, bound

    def step(self, state, row):
        outcomes = (state[0] + ("1" if row.failed else "0"))[-self.window :]
        rate = outcomes.count("1") / len(outcomes)
        above = len(outcomes) == self.window and rate > self.bound
        return (outcomes, above), [{"seq": row.seq, "rate": rate}] if above and not state[1] else []


class Recurs(_Keyed):
    """Tells when a series reaches its ``least``-th occurrence."""

    def __init__(self, least: int) -> None:
        self.least = least

    def step(self, state, row):
        n = state[0] + 1
        return (n,), [{"seq": row.seq, "n": n}] if n == self.least else []


class Incident(_Keyed):
    """Opens at a failure and closes after ``quiet`` outcomes without one; failures in between tell nothing."""

    state, start = "open boolean, good long", (False, 0)

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def step(self, state, row):
        if row.failed:
            return (True, 0), [] if state[0] else [{"seq": row.seq, "event": "open"}]
        good = state[1] + 1
        if state[0] and good >= self.quiet:
            return (False, 0), [{"seq": row.seq, "event": "close"}]
        return (state[0], good), []


class Queue(_Keyed):
    """The newest ``capacity`` events of a key; what a new one pushes out is told as lost."""

    state, start = "waiting array<long>", ([],)

    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ValueError("a queue holds at least one event")
        self.capacity = capacity

    def step(self, state, row):
        waiting = [*state[0], int(row.seq)]
        lost = waiting[: -self.capacity]
        return (waiting[-self.capacity :],), [{"seq": s, "lost_at": row.seq} for s in lost]


SCHEMAS = {DriftAlarm: "key {0}, seq long, rate double", Recurs: "key {0}, seq long, n long", Incident: "key {0}, seq long, event string", Queue: "key {0}, seq long, lost_at long"}


def told(rows: DataFrame, processor: _Keyed) -> DataFrame:
    """The rows that a processor tells over a stream (or a table) of (key, seq, ...)."""
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=SCHEMAS[type(processor)].format(kind), outputMode="append", timeMode="none")


# Batch forms.


def drift_alarms(rows: DataFrame, window: int, bound: float) -> DataFrame:
    """(key, seq, failed) -> (key, seq, rate) of the rows at which the share of failures of a full window passes the bound."""
    order = Window.partitionBy("key").orderBy("seq")
    last = order.rowsBetween(-(window - 1), 0)
    r = rows.select("key", "seq", F.avg(F.col("failed").cast("double")).over(last).alias("rate"), (F.count(F.lit(1)).over(last) == window).alias("full"))
    r = r.withColumn("above", F.col("full") & (F.col("rate") > bound)).withColumn("was", F.coalesce(F.lag("above").over(order), F.lit(False)))
    return r.where("above AND NOT was").select("key", "seq", "rate")


def recurrences(rows: DataFrame, least: int) -> DataFrame:
    """(key, seq) -> (key, seq, n) of each series' ``least``-th row."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("seq")).cast("long")
    return rows.select("key", "seq", n.alias("n")).where(F.col("n") == least)


def incidents(rows: DataFrame, quiet: int) -> DataFrame:
    """(key, seq, failed) -> (key, seq, event): a failure opens unless one of the ``quiet`` outcomes before it failed; the ``quiet``-th outcome after a last failure closes."""
    order = Window.partitionBy("key").orderBy("seq")
    r = rows.select("key", "seq", "failed", F.row_number().over(order).alias("k"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("last", F.max(F.when(F.col("failed"), F.col("k"))).over(before))
    gap = F.col("k") - F.col("last")
    event = F.when(F.col("failed") & (F.col("last").isNull() | (gap > quiet)), "open").when(~F.col("failed") & (gap == quiet), "close")
    return r.select("key", "seq", event.alias("event")).where("event IS NOT NULL")


def lost(rows: DataFrame, capacity: int) -> DataFrame:
    """(key, seq) -> (key, seq, lost_at): rows pushed out of a queue of that capacity, and the row that did it."""
    later = F.lead("seq", capacity).over(Window.partitionBy("key").orderBy("seq"))
    return rows.select("key", "seq", later.alias("lost_at")).where("lost_at IS NOT NULL")
