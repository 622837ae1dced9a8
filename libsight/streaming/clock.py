"""Reading clock and daily counters over a stream of ticks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from libsight.operators import reading
from libsight.streaming import state as versions

CREDITS = ("tick_id bigint, reader_id bigint, attachment_key bigint, item_key bigint, "
           "num_pages int, ts timestamp, credit_ms bigint, turned boolean, credited_page int")
_STATE = "attachment_key bigint, page int, since_ms bigint, focused boolean, tick_id bigint"
_EPOCH, _MICROSECOND = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)
_Credit = Row(*[f.split()[0] for f in CREDITS.split(", ")])


# --- per-reader state, for low latency

def advance(reader: int, ticks: pd.DataFrame, held: tuple | None, cap_ms: int) -> tuple[pd.DataFrame, tuple] | None:
    """Credited rows of a reader's new ticks, and the state after them; None if all ticks are old.

    ``held`` is the state before: attachment, page, time, focus and id of the last tick.  The clock never
    runs back: a tick before the last one neither credits nor counts.
    """
    ticks = ticks.sort_values(["ts", "tick_id"], ignore_index=True)
    at = ticks["ts"].astype("datetime64[us]").astype("int64") // 1000
    if held is not None:
        _, _, since, _, carried = held
        later = (at > since) | ((at == since) & (ticks["tick_id"] > carried))
        ticks, at = ticks[later].reset_index(drop=True), at[later].reset_index(drop=True)
        if ticks.empty:
            return None
    now = pd.DataFrame({"attachment_key": ticks["attachment_key"], "page": ticks["page"],
                        "since_ms": at, "focused": ticks["focused"].astype(bool)})
    before = now.shift(1)
    if held is not None:
        before.loc[0, list(now.columns)] = list(held)[:4]
    running = now["focused"] & (before["focused"] == True) & (  # noqa: E712 - missing is not True
        before["attachment_key"] == now["attachment_key"])
    gap = (now["since_ms"] - before["since_ms"].astype("float64")).clip(upper=cap_ms)
    credited = running & (gap > reading.CREDIT_FLOOR_MS)
    out = ticks.assign(
        reader_id=reader, credit_ms=gap.where(credited).astype("Int64"),
        turned=running & (before["page"] != now["page"]),
        credited_page=before["page"].astype("float64").astype("Int64"))
    last = now.iloc[-1]
    state = (int(last.attachment_key), int(last.page), int(last.since_ms), bool(last.focused),
             int(ticks["tick_id"].iloc[-1]))
    return out.loc[credited | out["turned"], [f.split()[0] for f in CREDITS.split(", ")]], state


def advance_rows(ticks: Iterable[Row], held: tuple | None, cap_ms: int) -> tuple[list[Row], tuple] | None:
    """As :func:`advance`, on rows: a reader has few ticks in a batch, and a frame for them costs more than they do.

    Ticks without a time neither credit nor count.
    """
    timed = sorted((((t.ts - _EPOCH) // _MICROSECOND, t.tick_id, t) for t in ticks if t.ts is not None),
                   key=lambda x: x[:2])
    found, last = [], held
    for micros, tick_id, tick in timed:
        at, focused = micros // 1000, bool(tick.focused)
        if held is not None and (at, tick_id) <= (held[2], held[4]):
            continue
        if last is not None:
            attachment, page, since, was_focused, _ = last
            running = focused and was_focused and attachment is not None and attachment == tick.attachment_key
            gap = min(at - since, cap_ms)
            credited = running and gap > reading.CREDIT_FLOOR_MS
            turned = running and (page is None or page != tick.page)
            if credited or turned:
                found.append(_Credit(tick_id, tick.reader_id, tick.attachment_key, tick.item_key, tick.num_pages,
                                     tick.ts, gap if credited else None, turned, page))
        last = (tick.attachment_key, tick.page, at, focused, tick_id)
    return None if last is held else (found, last)


def _clock(cap_ms: int, idle_ms: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        done = advance(key[0], pd.concat(list(frames)), group.get if group.exists else None, cap_ms)
        if done is not None:
            rows, state = done
            group.update(state)
            group.setTimeoutTimestamp(state[2] + idle_ms)
            yield rows
    return step


def stateful_credits(ticks: DataFrame, cap_seconds: float = reading.TICK_CAP_SECONDS,
                     idle_hours: float = 24, late: str = "1 day") -> DataFrame:
    """Credits as a stream, one clock per reader.

    A reader's ticks of one micro-batch meet in one task, so the source must be
    rate-limited; use :func:`credit_batches` for backfills and skewed readers.
    Ticks behind the watermark are dropped; the state of readers idle for
    ``idle_hours`` of event time expires.
    """
    step = _clock(int(cap_seconds * 1000), int(idle_hours * 3_600_000))
    return ticks.withWatermark("ts", late).groupBy("reader_id").applyInPandasWithState(
        step, CREDITS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --- per-batch state, spread like the batch form

def _carry_schema(ticks: StructType) -> StructType:
    return StructType([f for f in ticks if f.name in reading_fields(ticks.fieldNames())])


def reading_fields(columns: Sequence[str]) -> list[str]:
    wanted = ("tick_id", "reader_id", "attachment_key", "item_key", "page", "focused", "num_pages", "ts")
    return [c for c in wanted if c in columns]


def credit_batches(out: str, state: str, cap_seconds: float = reading.TICK_CAP_SECONDS) -> versions.BatchFn:
    """``foreachBatch`` function: credits of each batch, each reader's last tick carried over.

    The batch clock runs over the batch and the carried ticks, so a busy reader
    is spread by hour here as well.  A tick before the carried one credits nothing and
    does not set the clock back.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        fields = reading_fields(batch.columns)
        held = batch.select(*fields).persist()
        fresh = held
        carried = versions.read(batch.sparkSession, state, batch_id, _carry_schema(fresh.schema))
        passed = carried.select("reader_id", F.struct("ts", "tick_id").alias("_passed"))
        fresh = (fresh.join(passed, "reader_id", "left")
                 .where(F.col("_passed").isNull() | (F.struct("ts", "tick_id") > F.col("_passed")))
                 .select(*fields))
        rows = (carried.select(*fields).withColumn("_fresh", F.lit(False))
                .unionByName(fresh.withColumn("_fresh", F.lit(True))))
        order = ("_fresh", "ts", "tick_id")
        bucket = F.when(F.col("_fresh"), F.floor(F.unix_seconds("ts") / 3600)).otherwise(F.lit(-1))
        credited = reading.credits(rows, cap_seconds, order, bucket=bucket).where("_fresh")
        versions.emit(credited.drop("_fresh"), out, batch_id)
        last = rows.groupBy("reader_id").agg(F.max_by(
            F.struct(*[f for f in fields if f != "reader_id"]), F.struct("ts", "tick_id")).alias("_l"))
        versions.write(last.select("reader_id", "_l.*").select(*fields), state, batch_id)
        held.unpersist()
    return run


def daily_batches(out: str, timezone: str = "UTC", by: Sequence[str] = ()) -> versions.BatchFn:
    """``foreachBatch`` function over credits: sums per (day, item) of each batch.

    Sums and items are kept apart, so :func:`daily_totals` can add up batches
    and still count papers once.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        versions.emit(reading.rhythm_by_item(batch, timezone=timezone, by=by), out, batch_id)
    return run


def daily_totals(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily counters from the per-batch sums."""
    return reading.rhythm_totals(parts, by)


def daily_window(credits: DataFrame, late: str = "1 day", offset: str = "0 seconds") -> DataFrame:
    """Daily seconds and turns as a windowed aggregate; days close when the watermark passes.

    ``offset`` shifts the day to the reader's time zone.  Later rows are dropped
    and show up in the query's progress.
    """
    seconds = F.floor((F.col("credit_ms") + 500) / 1000)
    return (credits.withWatermark("ts", late)
            .groupBy(F.window("ts", "1 day", startTime=offset).alias("w"))
            .agg(F.coalesce(F.sum(seconds), F.lit(0)).alias("seconds"),
                 F.sum(F.col("turned").cast("bigint")).alias("pages"))
            .select(F.col("w.start").cast("date").alias("day"), "seconds", "pages"))
