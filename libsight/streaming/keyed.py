"""Streaming jobs on keyed state: the state store looks up the arriving keys and nothing else.

State is kept per key in RocksDB, so a batch costs what its rows cost, however much is remembered.
A query resumes from its checkpoint.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from libsight.operators import reading, review, watch
from libsight.session import RECOMMENDED, ship
from libsight.streaming import clock

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_state_store(spark: SparkSession) -> None:
    """Set what these jobs need for queries started later in this session.

    That is the state store, and this package on the path of the Python process that Spark starts beside
    the driver for stateful processors; executors have it by ``ship``.
    """
    ship(spark).conf.set(_PROVIDER, RECOMMENDED[_PROVIDER])
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def enrolled(annotations: DataFrame, deck: DataFrame | None = None, today: str | None = None) -> DataFrame:
    """Cards for annotations worth a review, each the first time it arrives; due tomorrow.

    ``deck`` (``card_key``) is a table of cards from before the stream.  A repeated annotation finds
    its key in the state store.  ``today`` is the day of each batch unless it is given.
    """
    fresh = annotations.where(review.reviewable()).dropDuplicates(["annotation_key"])
    if deck is not None:
        fresh = fresh.join(deck.select(F.col("card_key").alias("annotation_key")), "annotation_key", "left_anti")
    day = F.current_date() if today is None else F.lit(today).cast("date")
    zero = F.lit(0).cast("long")
    return fresh.select(F.col("annotation_key").alias("card_key"), "item_key", F.date_add(day, 1).alias("due"),
                        F.lit(0).alias("step"), zero.alias("lapses"), zero.alias("reviews"))


class _Alerts(StatefulProcessor):
    """Per watch: the newest ``memory`` ids shown, and whether it ran before."""

    def __init__(self, memory: int):
        self.memory = memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "finding_id string", "at bigint")
        self.ran = handle.getValueState("ran", "yes boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        known = {k[0]: v[0] for k, v in self.seen.iterator()}  # ``memory`` at most
        first, fresh = not self.ran.exists(), {}
        for row in rows:
            finding, at = row["finding_id"], row["at"]
            if finding is not None and finding not in known and (finding not in fresh or at > fresh[finding]):
                fresh[finding] = at
        if first:
            self.ran.update((True,))
        newest = sorted({**known, **fresh}.items(), key=lambda x: x[0])
        newest.sort(key=lambda x: x[1], reverse=True)  # stable: ties by id
        kept = dict(newest[:self.memory])
        for finding in known.keys() - kept.keys():
            self.seen.removeKey((finding,))
        for finding in fresh.keys() & kept.keys():
            self.seen.updateValue((finding,), (fresh[finding],))
        if not first:
            for finding, at in sorted(fresh.items()):
                yield Row(watch_id=key[0], finding_id=finding, at=at)

    def close(self) -> None:
        pass


def alerts(findings: DataFrame, memory: int = watch.MEMORY) -> DataFrame:
    """``watch_id, finding_id, seen_at`` of findings new to their watch; its first batch is the baseline.

    A watch remembers its newest ``memory`` ids (by ``seen_at``, ties by id); a forgotten one alerts again.  A row
    with a null ``finding_id`` says that the watch ran.  All rows of a watch in one batch are one run and
    meet in one task, which holds the run's new ids.
    """
    timed = findings.select("watch_id", "finding_id", F.unix_micros("seen_at").alias("at"))
    shown = timed.groupBy("watch_id").transformWithState(
        _Alerts(memory), "watch_id string, finding_id string, at bigint", "Append", "None")
    return shown.select("watch_id", "finding_id", F.timestamp_micros("at").alias("seen_at"))


class _Clock(StatefulProcessor):
    """Per reader: the last tick; forgotten after some time without ticks."""

    def __init__(self, cap_ms: int, idle_ms: int):
        self.cap_ms, self.idle_ms = cap_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState(
            "last", "attachment_key bigint, page int, since_ms bigint, focused boolean, tick_id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.last.get()
        done = clock.advance_rows(rows, held, self.cap_ms)
        if done is None:
            return iter(())
        found, state = done
        if held is not None:
            self.handle.deleteTimer(held[2] + self.idle_ms)
        self.last.update(state)
        self.handle.registerTimer(state[2] + self.idle_ms)
        return iter(found)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def credits(ticks: DataFrame, cap_seconds: float = reading.TICK_CAP_SECONDS, idle_hours: float = 24,
            late: str = "1 day") -> DataFrame:
    """Credits of a stream of ticks, with an event time that further operators can close windows by.

    As ``clock.stateful_credits``: a reader's ticks of one batch meet in one task; ticks behind the
    watermark drop; readers idle for ``idle_hours`` of event time are forgotten.
    """
    step = _Clock(int(cap_seconds * 1000), int(idle_hours * 3_600_000))
    return ticks.withWatermark("ts", late).groupBy("reader_id").transformWithState(
        step, clock.CREDITS, "Append", "EventTime", eventTimeColumnName="ts")


def days(credited: DataFrame, offset: str = "0 seconds") -> DataFrame:
    """Seconds and page turns by day, in the same query as the clock; a day is emitted once it is closed.

    ``offset`` shifts the day to the reader's time zone.
    """
    seconds = F.floor((F.col("credit_ms") + 500) / 1000)
    return (credited.groupBy(F.window("ts", "1 day", startTime=offset).alias("w"))
            .agg(F.coalesce(F.sum(seconds), F.lit(0)).alias("seconds"), F.sum(F.col("turned").cast("bigint")).alias("pages"))
            .select(F.col("w.start").cast("date").alias("day"), "seconds", "pages"))
