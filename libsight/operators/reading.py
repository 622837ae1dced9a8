"""Reading clock, dwell, rhythm, streaks and reading summaries.

Ticks: ``reader_id, attachment_key, page, focused, num_pages, ts, tick_id``.
Time credits are integers (milliseconds, tenths of a second), so sums do not
depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from libsight.functions import ordered
from libsight.functions.keys import local_day

TICK_CAP_SECONDS = 20
CREDIT_FLOOR_MS = 500


def credit_columns(now: dict[str, Column], prev: dict[str, Column],
                   cap_seconds: float) -> dict[str, Column]:
    """The clock rule for one tick and the tick before it of the same reader."""
    running = (F.coalesce(now["focused"], F.lit(False)) & F.coalesce(prev["focused"], F.lit(False))
               & (now["attachment_key"] == prev["attachment_key"]))
    elapsed = F.unix_millis(now["ts"]) - F.unix_millis(prev["ts"])
    capped = F.least(F.lit(int(cap_seconds * 1000)), elapsed)
    credit = F.when(running & (capped > CREDIT_FLOOR_MS), capped)
    return {"credit_ms": credit.cast("long"),
            "turned": F.coalesce(running & (now["page"] != prev["page"]), F.lit(False))}


def credits(ticks: DataFrame, cap_seconds: float = TICK_CAP_SECONDS,
            order: Sequence[str] = ("ts", "tick_id"), bucket_seconds: int = 3600,
            bucket: Column | None = None) -> DataFrame:
    """One row per tick that credits time or turns a page.

    Time goes to the page being left.  The look-back runs per reader and hour,
    so one very busy reader is spread over many tasks.
    """
    if bucket is None:
        bucket = F.floor(F.unix_seconds("ts") / bucket_seconds)
    paired = ordered.lag_struct(ticks, ["reader_id"], order, bucket,
                                ["focused", "attachment_key", "page", "ts"])
    names = ("focused", "attachment_key", "page", "ts")
    rule = credit_columns({n: F.col(n) for n in names},
                          {n: F.col("prev")[n] for n in names}, cap_seconds)
    return (paired.withColumns(rule)
            .where(F.col("credit_ms").isNotNull() | F.col("turned"))
            .withColumn("credited_page", F.col("prev")["page"]).drop("prev"))


def deciseconds(credit_ms: Column | str) -> Column:
    c = F.col(credit_ms) if isinstance(credit_ms, str) else credit_ms
    return F.floor((c + 50) / 100).cast("long")


def page_heat(credit_rows: DataFrame) -> DataFrame:
    """Tenths of a second per (attachment, page)."""
    return (credit_rows.where("credit_ms is not null")
            .groupBy("attachment_key", F.col("credited_page").alias("page"))
            .agg(F.sum(deciseconds("credit_ms")).alias("deciseconds")))


def attachment_heat(credit_rows: DataFrame) -> DataFrame:
    """Totals per attachment: time, first and last credit, last known page count."""
    known = F.when(F.col("num_pages") > 0, F.col("num_pages"))
    at = F.when(known.isNotNull(), F.struct("ts", "tick_id"))
    return (credit_rows.where("credit_ms is not null").groupBy("attachment_key")
            .agg(F.sum(deciseconds("credit_ms")).alias("deciseconds"),
                 F.min("ts").alias("first"), F.max("ts").alias("last"),
                 F.coalesce(F.max_by(known, at), F.lit(0)).alias("num_pages")))


def rhythm_by_item(credit_rows: DataFrame, owners: DataFrame | None = None,
                   annotations: DataFrame | None = None, timezone: str = "UTC",
                   by: Sequence[str] = ()) -> DataFrame:
    """Sums per (day, item): the part of the daily rhythm that adds up across batches."""
    rows = credit_rows
    if "item_key" not in rows.columns:
        rows = (ordered.skew_join(rows, owners, ["attachment_key"], "left") if owners is not None
                else rows.withColumn("item_key", F.lit(None).cast("long")))
    credited = F.col("credit_ms").isNotNull()
    reading = rows.select(
        *by, local_day("ts", timezone).alias("day"),
        F.when(credited, F.floor((F.col("credit_ms") + 500) / 1000)).alias("seconds"),
        F.col("turned").cast("long").alias("pages"), F.lit(0).alias("annotations"),
        F.when(credited, F.col("item_key")).alias("item_key"))
    if annotations is not None:
        zero = F.lit(0).cast("long")
        added = annotations.select(
            *by, local_day("ts", timezone).alias("day"), zero.alias("seconds"), zero.alias("pages"),
            F.lit(1).alias("annotations"),
            F.lit(None).cast(reading.schema["item_key"].dataType).alias("item_key"))
        reading = reading.unionByName(added)
    return reading.groupBy(*by, "day", "item_key").agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seconds", "pages", "annotations")])


def rhythm_totals(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily rhythm from per-item sums; a paper counts once a day."""
    per_item = parts.groupBy(*by, "day", "item_key").agg(*[
        F.sum(c).alias(c) for c in ("seconds", "pages", "annotations")])
    return per_item.groupBy(*by, "day").agg(
        *[F.sum(c).alias(c) for c in ("seconds", "pages", "annotations")],
        F.count("item_key").alias("items"))


def rhythm(credit_rows: DataFrame, owners: DataFrame | None = None,
           annotations: DataFrame | None = None, timezone: str = "UTC",
           by: Sequence[str] = ()) -> DataFrame:
    """Per local day: seconds, page turns, annotations added and papers touched.

    ``owners`` (attachment_key, item_key) is needed only where the credit rows
    lack ``item_key``; ``annotations`` needs ``ts`` and the ``by`` columns.
    Rows are reduced per (day, item) first, so the distinct count never gathers
    raw rows.
    """
    parts = rhythm_by_item(credit_rows, owners, annotations, timezone, by)
    return parts.groupBy(*by, "day").agg(
        *[F.sum(c).alias(c) for c in ("seconds", "pages", "annotations")],
        F.count("item_key").alias("items"))


def item_pages(pages: DataFrame, owners: DataFrame) -> DataFrame:
    """Tenths of a second per (item, page), over the item's attachments."""
    return (pages.join(owners, "attachment_key").groupBy("item_key", "page")
            .agg(F.sum("deciseconds").alias("deciseconds")))


def item_summary(pages: DataFrame, attachments: DataFrame, owners: DataFrame,
                 with_heat: bool = True) -> DataFrame:
    """Reading summary per item; ``owners`` is (attachment_key, item_key).

    The per-page array is as long as the item's highest page read.
    """
    per_page = item_pages(pages, owners).where(F.col("deciseconds") > 0)
    aggregates = [F.count("*").alias("pages_touched"), F.max("deciseconds").alias("max_heat_ds"),
                  (F.max("page") + 1).alias("_span")]
    if with_heat:
        aggregates.append(F.map_from_entries(
            F.collect_list(F.struct("page", "deciseconds"))).alias("_heat"))
    by_item = per_page.groupBy("item_key").agg(*aggregates)
    totals = (attachments.join(owners, "attachment_key").groupBy("item_key")
              .agg(F.sum("deciseconds").alias("deciseconds"), F.max("last").alias("last"),
                   F.max("num_pages").alias("_pages")))
    joined = totals.join(by_item, "item_key", "left")
    span = F.coalesce(F.col("_span"), F.lit(0))
    num_pages = F.when(F.col("_pages") > 0, F.col("_pages")).otherwise(span)
    out = joined.select(
        "item_key", (F.col("deciseconds") / 10).alias("seconds"),
        F.floor(F.col("deciseconds") / 600 + 0.5).alias("minutes"),
        F.coalesce("pages_touched", F.lit(0)).alias("pages_touched"),
        num_pages.cast("int").alias("num_pages"),
        F.when(num_pages > 0, F.coalesce("pages_touched", F.lit(0)) / num_pages)
        .otherwise(F.lit(0.0)).alias("coverage"),
        (F.coalesce("max_heat_ds", F.lit(0)) / 10).alias("max_heat"), "last",
        *(["_heat"] if with_heat else []), span.alias("_n"))
    if with_heat:
        pages_seq = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(
            F.array().cast("array<int>"))
        out = out.withColumn("heat", F.transform(pages_seq, lambda p: F.coalesce(
            F.try_element_at("_heat", p) / 10, F.lit(0.0))))
    return out.drop("_heat", "_n")


def resample_heat(heat: Column | str, pages: Column | str | None = None,
                  most: int = 120) -> Column:
    """Heat in at most ``most`` buckets, each the maximum of its page range."""
    h = F.col(heat) if isinstance(heat, str) else heat
    n = F.size(h) if pages is None else F.col(pages) if isinstance(pages, str) else pages
    n = F.when(n > 0, n).otherwise(F.size(h))
    buckets = F.greatest(F.lit(1), F.least(n, F.lit(most)))
    per = n / buckets

    def one(i: Column) -> Column:
        start = F.floor(i * per).cast("int")
        stop = F.ceil((i + 1) * per).cast("int")
        part = F.slice(h, start + 1, F.greatest(stop - start, F.lit(0)))
        return F.coalesce(F.array_max(part), F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), buckets - 1), one)


def heat_buckets(per_page: DataFrame, totals: DataFrame | None = None, most: int = 120) -> DataFrame:
    """``item_key, bucket, heat``: as ``resample_heat``, from the pages that were read and no others.

    ``per_page`` is ``item_pages``; ``totals`` (``item_key, num_pages``) gives the number of pages, else it is the
    highest page read.  A page falls into the one or two buckets whose ranges hold it, so an item costs
    what its pages cost, however high their numbers.  Buckets without heat have no row.
    """
    read = per_page.where((F.col("deciseconds") > 0) & (F.col("page") >= 0))
    spans = read.groupBy("item_key").agg((F.max("page").cast("long") + 1).alias("_n"))
    if totals is not None:
        given = totals.select("item_key", F.col("num_pages").cast("long").alias("_given"))
        spans = spans.join(given, "item_key", "left").select(
            "item_key", F.when(F.col("_given") > 0, F.col("_given")).otherwise(F.col("_n")).alias("_n"))
    buckets = F.least(F.col("_n"), F.lit(most).cast("long"))
    near = F.floor(F.col("page") / F.col("_per"))
    # rounding may shift a range by one bucket, so the neighbours are tried too
    spread = (read.join(spans, "item_key").withColumn("_b", buckets).withColumn("_per", F.col("_n") / F.col("_b"))
              .withColumn("bucket", F.explode(F.sequence(near - 1, near + 2))))
    inside = ((F.col("bucket") >= 0) & (F.col("bucket") < F.col("_b"))
              & (F.floor(F.col("bucket") * F.col("_per")) <= F.col("page"))
              & (F.ceil((F.col("bucket") + 1) * F.col("_per")) > F.col("page")))
    return spread.where(inside).groupBy("item_key", "bucket").agg((F.max("deciseconds") / 10).alias("heat"))


def page_intensity(value: Column, top: Column) -> Column:
    """Ratio of a page to the hottest page, clamped for display."""
    return F.when((value > 0) & (top > 0), F.greatest(
        F.lit(0.08), F.least(F.lit(1.0), value / top))).otherwise(F.lit(0.0))


def unread(mark: Column | str, seconds: Column | str) -> Column:
    """Explicit mark wins, otherwise up to 90 seconds is unread."""
    m = F.col(mark) if isinstance(mark, str) else mark
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(m.isNotNull(), ~m).otherwise(F.coalesce(s, F.lit(0.0)) <= 90)


def streak(daily: DataFrame, today: str, by: Sequence[str] = (),
           least_seconds: int = 60) -> DataFrame:
    """Consecutive days up to today (or yesterday) with enough reading.

    Works on the daily table, whose length per key is a number of days.
    """
    good = daily.where((F.col("seconds") >= least_seconds)
                       & (F.col("day") <= F.lit(today).cast("date")))
    w = Window.partitionBy(*by).orderBy(F.col("day")) if by else Window.orderBy(F.col("day"))
    island = good.withColumn("_island", F.date_sub("day", F.row_number().over(w)))
    runs = island.groupBy(*by, "_island").agg(F.count("*").alias("streak"),
                                              F.max("day").alias("_end"))
    return (runs.where(F.col("_end") >= F.date_sub(F.lit(today).cast("date"), 1))
            .groupBy(*by).agg(F.coalesce(F.max("streak"), F.lit(0)).alias("streak")))


def calendar(daily: DataFrame, today: str, days: int = 84) -> DataFrame:
    """One row per day of the last ``days``, with the shade of its reading time."""
    spark = daily.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(
        F.date_sub(F.lit(today).cast("date"), days - 1), F.lit(today).cast("date"))).alias("day"))
    scale = daily.agg(F.greatest(F.lit(1), F.coalesce(F.max("seconds"), F.lit(0))).alias("top"))
    # the scale is a single row, attached through a constant key
    joined = (spine.join(daily.select("day", "seconds"), "day", "left")
              .withColumn("_one", F.lit(1))
              .join(F.broadcast(scale.withColumn("_one", F.lit(1))), "_one"))
    seconds = F.coalesce("seconds", F.lit(0))
    return joined.select(
        "day", seconds.alias("seconds"),
        F.when(seconds > 0, F.floor((0.18 + seconds / F.col("top") * 0.82) * 100 + 0.5) / 100)
        .otherwise(F.lit(0.0)).alias("alpha"))


def today_card(daily: DataFrame, today: str, goal_minutes: int = 45) -> DataFrame:
    """Minutes against the goal, streak, papers touched, annotations added."""
    day = F.lit(today).cast("date")
    current = daily.agg(*[
        F.coalesce(F.sum(F.when(F.col("day") == day, F.col(c))), F.lit(0)).alias(c)
        for c in ("seconds", "items", "annotations")])
    both = current.withColumn("_one", F.lit(1)).join(
        streak(daily, today).withColumn("_one", F.lit(1)), "_one")
    return both.select(
        F.floor(F.col("seconds") / 60 + 0.5).alias("minutes"),
        F.lit(goal_minutes).alias("goal"), "streak",
        F.col("items").alias("papers"), "annotations")


def continue_reading(summary: DataFrame, attachments: DataFrame, owners: DataFrame,
                     most: int = 8, per_attachment: bool = False,
                     least_seconds: float = 120, finished: float = 0.92) -> DataFrame:
    """Shelf of started, unfinished papers, latest first."""
    started = (attachments.where(F.col("deciseconds") >= least_seconds * 10)
               .join(owners, "attachment_key").select("item_key", "attachment_key", "last"))
    if not per_attachment:
        started = started.groupBy("item_key").agg(F.max("last").alias("last"))
    keys = ["item_key"] + (["attachment_key"] if per_attachment else [])
    return (started.join(summary.drop("last"), "item_key")
            .where(F.col("coverage") <= finished)
            .select(*keys, "coverage", "minutes", "last")
            .orderBy(F.col("last").desc(), *keys).limit(most))


def clear_reading(table: DataFrame, removed: DataFrame) -> DataFrame:
    """Drop the reading of some attachments from a heat table."""
    return table.join(removed.select("attachment_key").distinct(), "attachment_key", "left_anti")
