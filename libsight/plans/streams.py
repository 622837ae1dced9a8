"""Streaming jobs over the tables: two runs each, with a stop between, equal to batch oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from libsight.operators import transform
from libsight.plans.ingest import _shout
from libsight.plans.reading import CAP, CLOCK, TODAY, _credits
from libsight.plans.registry import Tables, query
from libsight.session import checkpoint_dir, cut_lineage
from libsight.sources import snapshots
from libsight.streaming import clock, jobs, keyed, state


def _two_runs(rows: DataFrame, first: F.Column, job) -> DataFrame:
    """What ``job(base)`` emits when ``rows`` arrive in two parts, the query restarting between."""
    spark = rows.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    for part in (rows.where(first), rows.where(~first)):
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        state.writer(stream, job(base), f"{base}/checkpoint").start().awaitTermination()
    out = cut_lineage(spark.read.parquet(f"{base}/out").drop("batch_id"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def _kept_run(rows: DataFrame, first: F.Column, streamed) -> DataFrame:
    """What the streaming DataFrame ``streamed(rows)`` appends when ``rows`` arrive in two parts.

    State lives in the state store; the query is stopped and resumed between the parts.
    """
    spark = rows.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    keyed.use_state_store(spark)
    for part in (rows.where(first), rows.where(~first)):
        part.write.mode("append").parquet(f"{base}/in")
        stream = streamed(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        (stream.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    out = cut_lineage(spark.read.schema(stream.schema).parquet(f"{base}/out"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


#: Half way through the events' days; as SQL and as a condition on a day column.
HALF = "(SELECT min(CAST(ts AS DATE)) + CAST((max(CAST(ts AS DATE)) - min(CAST(ts AS DATE))) // 2 AS INT) FROM events)"


def _early(t: Tables, day: F.Column) -> F.Column:
    days = t.events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    return day <= F.lit(days[0] + (days[1] - days[0]) // 2 if days[0] else None)


@query(CLOCK + "SELECT tick_id, reader_id, pp AS credited_page, credit_ms, turned FROM clock "
               "WHERE credit_ms IS NOT NULL OR turned")
def stream_clock(t: Tables) -> DataFrame:
    done = _two_runs(t.ticks, _early(t, F.to_date("ts")),
                     lambda base: clock.credit_batches(f"{base}/out", f"{base}/state", CAP))
    return done.select("tick_id", "reader_id", "credited_page", "credit_ms", "turned")


@query(CLOCK + "SELECT CAST(day AS VARCHAR) AS day, seconds, pages, items FROM daily")
def stream_daily(t: Tables) -> DataFrame:
    parts = _two_runs(_credits(t), _early(t, F.to_date("ts")), lambda base: clock.daily_batches(f"{base}/out"))
    return clock.daily_totals(parts).select(F.col("day").cast("string").alias("day"), "seconds", "pages", "items")


@query(f"""SELECT annotation_key AS card_key, item_key, CAST(DATE '{TODAY}' + 1 AS VARCHAR) AS due
FROM annotations WHERE length(text || ' ' || text) >= 25""")
def stream_enrol(t: Tables) -> DataFrame:
    marks = t.annotations.withColumns({"comment": F.concat_ws(" ", "text", "text"), "text": F.lit("")})
    # every third annotation arrives twice
    again = marks.where("annotation_key % 3 = 0").withColumn("part", F.lit(2))
    fed = marks.withColumn("part", F.when(F.col("annotation_key") % 2 == 0, 2).otherwise(1)).unionByName(again)
    done = _two_runs(fed, F.col("part") == 1, lambda base: jobs.enrol_batches(f"{base}/out", f"{base}/state", TODAY))
    return done.select("card_key", "item_key", F.col("due").cast("string").alias("due"))


@query(f"""WITH runs AS (SELECT DISTINCT event_type AS watch_id, user_id || props AS finding_id,
  CAST(ts AS DATE) <= {HALF} AS early FROM events)
SELECT DISTINCT watch_id, finding_id FROM runs WHERE NOT early
AND (watch_id, finding_id) NOT IN (SELECT (watch_id, finding_id) FROM runs WHERE early)
AND watch_id IN (SELECT watch_id FROM runs WHERE early)""")
def stream_alerts(t: Tables) -> DataFrame:
    found = t.events.select(F.col("event_type").alias("watch_id"),
                            F.concat(F.col("user_id").cast("string"), "props").alias("finding_id"),
                            F.col("ts").alias("seen_at"))
    done = _two_runs(found, _early(t, F.to_date("seen_at")), lambda base: jobs.alert_batches(
        f"{base}/out", f"{base}/state", memory=1_000_000_000))
    return done.select("watch_id", "finding_id")


@query(f"""SELECT annotation_key AS card_key, item_key, CAST(DATE '{TODAY}' + 1 AS VARCHAR) AS due
FROM annotations WHERE length(text || ' ' || text) >= 25 AND annotation_key % 11 <> 0""")
def stream_enrol_keyed(t: Tables) -> DataFrame:
    marks = t.annotations.withColumns({"comment": F.concat_ws(" ", "text", "text"), "text": F.lit("")})
    again = marks.where("annotation_key % 3 = 0").withColumn("part", F.lit(2))
    fed = marks.withColumn("part", F.when(F.col("annotation_key") % 2 == 0, 2).otherwise(1)).unionByName(again)
    deck = t.annotations.where("annotation_key % 11 = 0").select(F.col("annotation_key").alias("card_key"))
    done = _kept_run(fed, F.col("part") == 1, lambda rows: keyed.enrolled(rows, deck, TODAY))
    return done.select("card_key", "item_key", F.col("due").cast("string").alias("due"))


@query(f"""WITH runs AS (SELECT event_type AS watch_id, user_id || props AS finding_id, max(ts) AS seen_at,
  CAST(ts AS DATE) <= {HALF} AS early FROM events GROUP BY ALL),
seen AS (SELECT watch_id, finding_id FROM (SELECT *, row_number() OVER (
  PARTITION BY watch_id ORDER BY seen_at DESC, finding_id) AS n FROM runs WHERE early) x WHERE n <= 400)
SELECT watch_id, finding_id FROM runs WHERE NOT early AND (watch_id, finding_id) NOT IN (SELECT (watch_id, finding_id) FROM seen)
AND watch_id IN (SELECT watch_id FROM runs WHERE early)""")
def stream_alerts_keyed(t: Tables) -> DataFrame:
    found = t.events.select(F.col("event_type").alias("watch_id"),
                            F.concat(F.col("user_id").cast("string"), "props").alias("finding_id"),
                            F.col("ts").alias("seen_at"))
    return _kept_run(found, _early(t, F.to_date("seen_at")), keyed.alerts).select("watch_id", "finding_id")


@query(CLOCK + "SELECT tick_id, reader_id, pp AS credited_page, credit_ms, turned FROM clock "
               "WHERE credit_ms IS NOT NULL OR turned")
def stream_clock_keyed(t: Tables) -> DataFrame:
    done = _kept_run(t.ticks, _early(t, F.to_date("ts")), lambda rows: keyed.credits(rows, CAP, idle_hours=24 * 400))
    return done.select("tick_id", "reader_id", "credited_page", "credit_ms", "turned")


@query(CLOCK + """SELECT CAST(day AS VARCHAR) AS day, seconds, pages FROM daily
WHERE day + 1 <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND (seconds > 0 OR pages > 0)""")
def stream_days(t: Tables) -> DataFrame:
    done = _kept_run(t.ticks, _early(t, F.to_date("ts")), lambda rows: keyed.days(keyed.credits(
        rows, CAP, idle_hours=24 * 400)))
    return done.select(F.col("day").cast("string").alias("day"), "seconds", "pages")


@query(CLOCK + "SELECT tick_id, reader_id, pp AS credited_page, credit_ms, turned FROM clock "
               "WHERE credit_ms IS NOT NULL OR turned")
def tick_source(t: Tables) -> DataFrame:
    """Poll logs land in four parts; the stream takes one log at a time and is stopped after three of them."""
    spark = t.spark
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    keyed.use_state_store(spark)
    polled = t.ticks
    quarter = F.ntile(4).over(Window.orderBy("day"))
    days = cut_lineage(polled.select(F.to_date("ts").alias("day")).distinct().withColumn("part", quarter))
    dated = polled.withColumn("day", F.to_date("ts")).join(F.broadcast(days), "day")  # one row a day
    for part in (1, 2, 3, 4):
        snapshots.land_ticks(dated.where(F.col("part") == part), f"{base}/log")
        if part < 3:
            continue
        arriving = snapshots.ticks(spark, f"{base}/log", streaming=True, form="json", files_per_batch=1)
        out = keyed.credits(arriving, CAP, idle_hours=24 * 400)
        (out.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    done = cut_lineage(spark.read.schema(out.schema).parquet(f"{base}/out"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return done.select("tick_id", "reader_id", "credited_page", "credit_ms", "turned")


@query("""SELECT item_key, replace(title, 'e', 'E') AS title_translated, replace('on ' || venue, 'e', 'E') AS abstract_translated
FROM items WHERE item_key % 4 <> 0""")
def arrival_translate(t: Tables) -> DataFrame:
    """New items in two runs; a quarter has a blank abstract and is left alone, texts of the first run come from the cache."""
    abstract = F.when(F.col("item_key") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit("on "), "venue"))
    items = t.items.select("item_key", "title", abstract.alias("abstract"))
    engines = [transform.Engine("shout", _shout)]
    done = _two_runs(items, F.col("item_key") % 2 == 0, lambda base: jobs.translate_batches(
        f"{base}/out", engines, "shout", "en", cache=f"{base}/cache"))
    return done.select("item_key", "title_translated", "abstract_translated")
