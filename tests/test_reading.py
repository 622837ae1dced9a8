"""Reading clock against a row-at-a-time model, in batch and as a stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from libsight.operators import reading
from libsight.streaming import clock, state

SCHEMA = ("tick_id bigint, reader_id bigint, attachment_key bigint, item_key bigint, page int, "
          "focused boolean, num_pages int, ts timestamp")
START = dt.datetime(2024, 1, 1)


def model(rows, cap_ms=20_000):
    """Credits (tick_id, page left, ms or None, turned) by the event loop."""
    clocks, out = {}, []
    for tick, reader, key, _item, page, focused, _n, ts in sorted(rows, key=lambda r: (r[7], r[0])):
        now = round((ts - START).total_seconds() * 1000)
        held = clocks.get(reader)
        if not focused:
            clocks.pop(reader, None)
            continue
        clocks[reader] = (key, page, now)
        if held is None or held[0] != key:
            continue
        ms = min(cap_ms, now - held[2])
        turned = held[1] != page
        if ms > 500 or turned:
            out.append((tick, held[1], ms if ms > 500 else None, turned))
    return sorted(out, key=lambda r: r[0])


def random_ticks(seed, n=400, hot=0.5):
    rng = random.Random(seed)
    now, rows = 0, []
    for i in range(n):
        now += rng.choice([0, 200, 400, 501, 3000, 5000, 30_000, 4_000_000])
        reader = 1 if rng.random() < hot else rng.randint(2, 4)
        rows.append((i, reader, rng.randint(1, 2), reader * 10, rng.randint(0, 3), rng.random() < 0.85,
                     rng.choice([0, 9]), START + dt.timedelta(milliseconds=now)))
    return rows


def credits_of(df):
    return sorted((r.tick_id, r.credited_page, r.credit_ms, r.turned) for r in df.collect())


def test_clock_equals_the_event_loop(spark):
    for seed in range(2):
        rows = random_ticks(seed)
        got = reading.credits(spark.createDataFrame(rows, SCHEMA))
        assert credits_of(got) == model(rows)


def test_clock_does_not_depend_on_the_bucket(spark):
    ticks = spark.createDataFrame(random_ticks(7), SCHEMA)
    wide = reading.credits(ticks, bucket_seconds=10 ** 9)
    narrow = reading.credits(ticks, bucket_seconds=2)
    assert credits_of(wide) == credits_of(narrow)


def test_hand_worked_ticks(spark):
    def t(i, seconds, page, focused=True, key=1):
        return (i, 1, key, 10, page, focused, 5, START + dt.timedelta(seconds=seconds))

    rows = [t(0, 0, 0), t(1, 5, 0), t(2, 10, 1), t(3, 10.3, 2), t(4, 60, 2), t(5, 65, 2, False),
            t(6, 70, 2), t(7, 75, 2, key=2), t(8, 80, 2, key=2)]
    got = credits_of(reading.credits(spark.createDataFrame(rows, SCHEMA)))
    assert got == [(1, 0, 5000, False), (2, 0, 5000, True), (3, 1, None, True), (4, 2, 20000, False),
                   (8, 2, 5000, False)]


def _stream(spark, rows, folder, parts):
    ordered = sorted(rows, key=lambda r: (r[7], r[0]))
    size = -(-len(ordered) // parts)
    for i in range(parts):
        piece = ordered[i * size:(i + 1) * size]
        random.Random(i).shuffle(piece)
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))


def test_batches_with_carried_ticks_equal_the_batch_form(spark, folder):
    rows = random_ticks(11)
    stream = _stream(spark, rows, folder, 2)
    run = clock.credit_batches(f"{folder}/out", f"{folder}/state")
    state.writer(stream, run, f"{folder}/ckpt").start().awaitTermination()
    assert credits_of(spark.read.parquet(f"{folder}/out")) == model(rows)


def test_stateful_clock_equals_the_batch_form(spark, folder):
    rows = random_ticks(12)
    stream = _stream(spark, rows, folder, 2)
    query = (clock.stateful_credits(stream).writeStream.format("parquet")
             .option("checkpointLocation", f"{folder}/ckpt").option("path", f"{folder}/out")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert credits_of(spark.read.parquet(f"{folder}/out")) == model(rows)


def test_daily_batches_add_up(spark, folder):
    rows = random_ticks(13)
    credits = reading.credits(spark.createDataFrame(rows, SCHEMA))
    credits.repartition(2).write.parquet(f"{folder}/credits")
    stream = (spark.readStream.schema(spark.read.parquet(f"{folder}/credits").schema)
              .option("maxFilesPerTrigger", 1).parquet(f"{folder}/credits"))
    state.writer(stream, clock.daily_batches(f"{folder}/daily"), f"{folder}/c").start().awaitTermination()
    got = clock.daily_totals(spark.read.parquet(f"{folder}/daily")).orderBy("day").collect()
    want = reading.rhythm(credits).orderBy("day").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_daily_window_closes_days(spark, folder):
    rows = [(i, 1, 1, 1, 0, True, 1, START + dt.timedelta(hours=i)) for i in range(120)]
    credits = reading.credits(spark.createDataFrame(rows, SCHEMA), cap_seconds=7200)
    credits.write.parquet(f"{folder}/credits")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/credits").schema).parquet(f"{folder}/credits")
    query = (clock.daily_window(stream).writeStream.format("memory").queryName("daily_w").outputMode("append")
             .option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start())
    query.awaitTermination()
    days = {str(r.day): r.seconds for r in spark.table("daily_w").collect()}
    assert days["2024-01-02"] == 24 * 3600


def test_streak_skips_an_empty_today(spark):
    days = [("2024-01-27", 600), ("2024-01-28", 59), ("2024-01-29", 60), ("2024-01-30", 61)]
    daily = spark.createDataFrame(days, "d string, seconds bigint").withColumn("day", F.to_date("d"))
    assert reading.streak(daily, "2024-01-30").collect()[0].streak == 2
    assert reading.streak(daily, "2024-01-31").collect()[0].streak == 2
    assert reading.streak(daily, "2024-02-01").collect()[0].streak == 0


def test_item_summary_and_shelf(spark):
    pages = spark.createDataFrame([(1, 0, 600), (1, 2, 900), (2, 2, 50)], "attachment_key int, page int, deciseconds bigint")
    totals = spark.createDataFrame([(1, 1500, START, 4), (2, 50, START + dt.timedelta(days=1), 0)],
                                   "attachment_key int, deciseconds bigint, last timestamp, num_pages int")
    owners = spark.createDataFrame([(1, 7), (2, 7)], "attachment_key int, item_key int")
    row = reading.item_summary(pages, totals, owners).collect()[0]
    assert (row.seconds, row.minutes, row.pages_touched, row.num_pages, row.coverage) == (155.0, 3, 2, 4, 0.5)
    assert row.heat == [60.0, 0.0, 95.0]
    summary = reading.item_summary(pages, totals, owners, with_heat=False)
    assert [r.item_key for r in reading.continue_reading(summary, totals, owners).collect()] == [7]
    shelf = reading.continue_reading(summary, totals, owners, per_attachment=True).collect()
    assert [r.attachment_key for r in shelf] == [1]


def test_resampled_heat_overlaps(spark):
    df = spark.createDataFrame([([1.0, 5.0, 2.0, 0.0, 3.0],)], "heat array<double>")
    assert df.select(reading.resample_heat("heat", most=2)).collect()[0][0] == [5.0, 3.0]


def test_late_tick_does_not_set_the_clock_back(spark, folder):
    def t(i, seconds):
        return (i, 1, 1, 10, 0, True, 5, START + dt.timedelta(seconds=seconds))

    for part in ([t(0, 0), t(1, 10)], [t(2, 3)], [t(3, 12)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    state.writer(stream, clock.credit_batches(f"{folder}/out", f"{folder}/state"), f"{folder}/c").start().awaitTermination()
    assert sum(r.credit_ms or 0 for r in spark.read.parquet(f"{folder}/out").collect()) == 12_000
    query = (clock.stateful_credits(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/c2")
             .option("path", f"{folder}/out2").trigger(availableNow=True).start())
    query.awaitTermination()
    assert sum(r.credit_ms or 0 for r in spark.read.parquet(f"{folder}/out2").collect()) == 12_000


def test_heat_buckets_equal_the_dense_resampling(spark):
    """Long rows give what the arrays give; a page number out of all bounds costs one row."""
    rng = random.Random(12)
    rows = [(item, page, rng.randint(0, 50)) for item in range(40) for page in rng.sample(range(1 + item * 9), min(1 + item * 9, 12))]
    pages = spark.createDataFrame(rows, "item_key int, page int, deciseconds bigint")
    heat = {}
    for item, page, ds in rows:
        if ds:
            heat.setdefault(item, {})[page] = ds / 10
    dense = spark.createDataFrame([(i, [h.get(p, 0.0) for p in range(max(h) + 1)]) for i, h in heat.items()],
                                  "item_key int, heat array<double>")
    for most in (1, 7, 120):
        wide = dense.select("item_key", reading.resample_heat("heat", most=most).alias("b")).collect()
        want = {(r.item_key, i, x) for r in wide for i, x in enumerate(r.b) if x > 0}
        assert {tuple(r) for r in reading.heat_buckets(pages, most=most).collect()} == want
    totals = spark.createDataFrame([(1, 500), (2, 0)], "item_key int, num_pages int")
    wide = dense.join(totals, "item_key").select("item_key", reading.resample_heat("heat", "num_pages", 30).alias("b")).collect()
    some = pages.join(totals.select("item_key"), "item_key", "left_semi")
    assert {tuple(r) for r in reading.heat_buckets(some, totals, 30).collect()} == {
        (r.item_key, i, x) for r in wide for i, x in enumerate(r.b) if x > 0}
    odd = spark.createDataFrame([(1, 2**31 - 1, 5), (1, 0, 7), (1, -1, 9)], "item_key int, page int, deciseconds bigint")
    assert sorted(tuple(r) for r in reading.heat_buckets(odd).collect()) == [(1, 0, 0.7), (1, 119, 0.5)]


def test_clock_on_rows_equals_the_clock_on_frames():
    import pandas as pd
    from pyspark.sql import Row
    draw, start, naive = random.Random(7), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), {"tzinfo": None}
    for _ in range(60):
        ticks = [dict(tick_id=i, reader_id=4, attachment_key=draw.randrange(2), item_key=1, page=draw.randrange(3), num_pages=9,
                      focused=draw.random() < 0.8, ts=start + dt.timedelta(microseconds=draw.randrange(60_000_000))) for i in range(12)]
        held_rows = held_frames = None
        for part in (ticks[:6], ticks[6:]):
            rows = clock.advance_rows([Row(**t) for t in part], held_rows, 20_000)
            frames = clock.advance(4, pd.DataFrame([{**t, "ts": t["ts"].replace(**naive)} for t in part]), held_frames, 20_000)
            assert (rows is None) == (frames is None)
            if rows is None:
                continue
            want = [tuple(None if pd.isna(v) else v for v in r) for r in frames[0].itertuples(index=False)]
            assert [(*r[:5], r[5].replace(**naive), *r[6:]) for r in rows[0]] == want and rows[1] == frames[1]
            held_rows, held_frames = rows[1], frames[1]
