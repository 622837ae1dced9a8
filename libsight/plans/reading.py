"""Reading-activity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from libsight.functions.keys import rating, read_mark
from libsight.operators import reading
from libsight.plans.registry import Tables, query

TODAY = "2024-01-30"
CAP = 7200  # the event table ticks hours apart, not seconds

# the clock rule as window SQL, shared by the oracles
CLOCK = f"""WITH lagged AS (
  SELECT *, lag(focused) OVER w AS pf, lag(attachment_key) OVER w AS pk, lag(page) OVER w AS pp,
         epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w AS gap
  FROM ticks WINDOW w AS (PARTITION BY reader_id ORDER BY ts, tick_id)),
clock AS (
  SELECT *, CASE WHEN live AND least(gap, {CAP * 1000}) > 500 THEN least(gap, {CAP * 1000}) END AS credit_ms,
         coalesce(live AND page <> pp, false) AS turned
  FROM (SELECT *, coalesce(focused AND pf AND attachment_key = pk, false) AS live FROM lagged) l),
heat AS (
  SELECT attachment_key, pp AS page, CAST(sum((credit_ms + 50) // 100) AS BIGINT) AS deciseconds
  FROM clock WHERE credit_ms IS NOT NULL GROUP BY ALL),
totals AS (
  SELECT attachment_key, CAST(sum((credit_ms + 50) // 100) AS BIGINT) AS deciseconds,
         min(ts) AS first, max(ts) AS last, arg_max(num_pages, ts) AS num_pages
  FROM clock WHERE credit_ms IS NOT NULL GROUP BY ALL),
daily AS (
  SELECT CAST(ts AS DATE) AS day, CAST(coalesce(sum((credit_ms + 500) // 1000), 0) AS BIGINT) AS seconds,
         CAST(sum(CAST(turned AS INT)) AS BIGINT) AS pages,
         count(DISTINCT CASE WHEN credit_ms IS NOT NULL THEN item_key END) AS items
  FROM clock WHERE credit_ms IS NOT NULL OR turned GROUP BY ALL),
reader_daily AS (
  SELECT reader_id, CAST(ts AS DATE) AS day, CAST(coalesce(sum((credit_ms + 500) // 1000), 0) AS BIGINT) AS seconds
  FROM clock WHERE credit_ms IS NOT NULL OR turned GROUP BY ALL),
item_heat AS (
  SELECT item_key, page, CAST(sum(deciseconds) AS BIGINT) AS ds
  FROM heat JOIN attachments USING (attachment_key) GROUP BY ALL),
summary AS (
  SELECT t.item_key, CAST(sum(deciseconds) AS BIGINT) AS ds, max(last) AS last,
         max(num_pages) AS num_pages, any_value(touched) AS touched, any_value(top) AS top
  FROM (SELECT * FROM totals JOIN attachments USING (attachment_key)) t
  LEFT JOIN (SELECT item_key, count(*) AS touched, max(ds) AS top FROM item_heat WHERE ds > 0 GROUP BY ALL) h
    ON h.item_key = t.item_key
  GROUP BY t.item_key)
"""
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def _stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _credits(t: Tables) -> DataFrame:
    return reading.credits(t.ticks, CAP)


def _daily(t: Tables) -> DataFrame:
    return reading.rhythm(_credits(t))


def _parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    credits = _credits(t)
    return reading.page_heat(credits), reading.attachment_heat(credits), t.attachments


@query(CLOCK + "SELECT tick_id, reader_id, pp AS credited_page, credit_ms, turned FROM clock "
               "WHERE credit_ms IS NOT NULL OR turned")
def reading_clock(t: Tables) -> DataFrame:
    return _credits(t).select("tick_id", "reader_id", "credited_page", "credit_ms", "turned")


@query(CLOCK + "SELECT attachment_key, page, deciseconds FROM heat")
def page_dwell(t: Tables) -> DataFrame:
    return reading.page_heat(_credits(t))


@query(CLOCK + f"SELECT attachment_key, deciseconds, strftime(first, {STAMP}) AS first, "
               f"strftime(last, {STAMP}) AS last, num_pages FROM totals")
def attachment_totals(t: Tables) -> DataFrame:
    return (reading.attachment_heat(_credits(t))
            .withColumns({"first": _stamp("first"), "last": _stamp("last")}))


ANNOTATED = """
SELECT CAST(coalesce(d.day, a.day) AS VARCHAR) AS day, coalesce(seconds, 0) AS seconds,
       coalesce(pages, 0) AS pages, coalesce(n, 0) AS annotations, coalesce(items, 0) AS items
FROM daily d FULL JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM annotations GROUP BY ALL) a
  ON a.day = d.day"""


@query(CLOCK + ANNOTATED)
def daily_rhythm(t: Tables) -> DataFrame:
    daily = reading.rhythm(_credits(t), annotations=t.annotations)
    return daily.withColumn("day", F.col("day").cast("string"))


@query(CLOCK + """
SELECT item_key, ds / 10 AS seconds, CAST(floor(ds / 600 + 0.5) AS BIGINT) AS minutes,
       coalesce(touched, 0) AS pages_touched, num_pages,
       round(coalesce(touched, 0) / num_pages, 6) AS coverage, coalesce(top, 0) / 10 AS max_heat
FROM summary""")
def item_reading_summary(t: Tables) -> DataFrame:
    out = reading.item_summary(*_parts(t), with_heat=False)
    return out.withColumn("coverage", F.round("coverage", 6)).drop("last")


@query(CLOCK + """
SELECT item_key, b AS bucket, coalesce(max(ds), 0) / 10 AS heat
FROM (SELECT item_key, max(page) + 1 AS n FROM item_heat WHERE ds > 0 GROUP BY ALL) s
JOIN range(120) r(b) ON b < least(n, 8)
LEFT JOIN item_heat h USING (item_key)
WHERE h.page >= floor(b * (n / least(n, 8))) AND h.page < ceil((b + 1) * (n / least(n, 8)))
GROUP BY ALL HAVING max(ds) > 0""")
def heat_resample(t: Tables) -> DataFrame:
    pages, _, owners = _parts(t)
    return reading.heat_buckets(reading.item_pages(pages, owners), most=8)


@query(CLOCK + """
SELECT CAST(item_key AS BIGINT) AS item_key, page, round(CASE WHEN ds > 0 THEN
         greatest(0.08, least(1.0, ds / max(ds) OVER (PARTITION BY item_key))) ELSE 0 END, 6) AS shade
FROM item_heat""")
def page_shade(t: Tables) -> DataFrame:
    pages, _, owners = _parts(t)
    heat = reading.item_pages(pages, owners)
    top = heat.groupBy("item_key").agg(F.max("deciseconds").alias("top"))
    return heat.join(top, "item_key").select("item_key", "page", F.round(
        reading.page_intensity(F.col("deciseconds"), F.col("top")), 6).alias("shade"))


@query(CLOCK + f""", good AS (
  SELECT reader_id, day, day - CAST(row_number() OVER (PARTITION BY reader_id ORDER BY day) AS INT) AS island
  FROM reader_daily WHERE seconds >= 60 AND day <= DATE '{TODAY}')
SELECT reader_id, max(n) AS streak FROM (
  SELECT reader_id, island, count(*) AS n, max(day) AS ending FROM good GROUP BY ALL) r
WHERE ending >= DATE '{TODAY}' - 1 GROUP BY reader_id""")
def reading_streak(t: Tables) -> DataFrame:
    return reading.streak(reading.rhythm(_credits(t), by=["reader_id"]), TODAY, ["reader_id"])


@query(CLOCK + f"""
SELECT CAST(s.day AS VARCHAR) AS day, coalesce(d.seconds, 0) AS seconds,
       CASE WHEN coalesce(d.seconds, 0) > 0 THEN
         floor((0.18 + d.seconds / (SELECT greatest(1, max(seconds)) FROM daily) * 0.82) * 100 + 0.5) / 100
         ELSE 0.0::DOUBLE END AS alpha
FROM (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - 83, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day) s
LEFT JOIN daily d USING (day)""")
def rhythm_calendar(t: Tables) -> DataFrame:
    out = reading.calendar(_daily(t), TODAY)
    return out.withColumn("day", F.col("day").cast("string"))


@query(CLOCK + f""", good AS (
  SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INT) AS island
  FROM daily WHERE seconds >= 60 AND day <= DATE '{TODAY}')
SELECT CAST(floor(coalesce(sum(seconds), 0) / 60 + 0.5) AS BIGINT) AS minutes, 45 AS goal,
       (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n, max(day) AS ending FROM good GROUP BY island) r
        WHERE ending >= DATE '{TODAY}' - 1) AS streak,
       CAST(coalesce(sum(items), 0) AS BIGINT) AS papers, CAST(0 AS BIGINT) AS annotations
FROM daily WHERE day = DATE '{TODAY}'""")
def today_card(t: Tables) -> DataFrame:
    return reading.today_card(_daily(t), TODAY)


@query(CLOCK + f"""
SELECT s.item_key, round(s.touched / s.num_pages, 6) AS coverage,
       CAST(floor(s.ds / 600 + 0.5) AS BIGINT) AS minutes, strftime(x.last, {STAMP}) AS last
FROM (SELECT item_key, max(last) AS last FROM totals JOIN attachments USING (attachment_key)
      WHERE deciseconds >= 1200 GROUP BY ALL) x
JOIN summary s USING (item_key) WHERE coalesce(s.touched, 0) / s.num_pages <= 0.92
ORDER BY x.last DESC, s.item_key LIMIT 8""")
def continue_reading(t: Tables) -> DataFrame:
    pages, totals, owners = _parts(t)
    summary = reading.item_summary(pages, totals, owners, with_heat=False)
    return (reading.continue_reading(summary, totals, owners)
            .withColumns({"coverage": F.round("coverage", 6), "last": _stamp("last")}))


@query(CLOCK + """
SELECT i.item_key, CASE WHEN i.item_key % 3 = 0 THEN coalesce(s.ds / 10, 0) <= 90
                        ELSE i.item_key % 2 = 0 END AS unread
FROM items i LEFT JOIN summary s USING (item_key)""")
def unread_flag(t: Tables) -> DataFrame:
    summary = reading.item_summary(*_parts(t), with_heat=False).select("item_key", "seconds")
    # every third paper carries no mark, so both branches decide rows
    mark = F.when(F.col("item_key") % 3 != 0, read_mark("extra"))
    return (t.items.select("item_key", mark.alias("mark")).join(summary, "item_key", "left")
            .select("item_key", reading.unread("mark", "seconds").alias("unread")))


@query(CLOCK + """
SELECT attachment_key, page, deciseconds FROM heat
WHERE attachment_key NOT IN (SELECT attachment_key FROM attachments JOIN items USING (item_key)
                             WHERE regexp_extract(extra, 'lib-rating: ([0-9])', 1) = '0')""")
def clear_reading(t: Tables) -> DataFrame:
    unrated = t.items.where(rating("extra") == 0)
    removed = t.attachments.join(unrated, "item_key", "left_semi")
    return reading.clear_reading(reading.page_heat(_credits(t)), removed)
