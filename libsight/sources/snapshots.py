"""State snapshots (one JSON map per file and library) into tables, and table sinks.

A folder may hold many libraries' files; large ones are cut at their entries (``jsonmaps``), so one file is
read by many tasks.  An entry that is not of its kind's shape is left out, the others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from libsight.functions.ordered import broadcast_if_small
from libsight.sources import jsonmaps
from libsight.session import cut_lineage

_CHUNK = ("struct<id:string,itemID:bigint,itemKey:string,attachmentID:bigint,title:string,"
          "page:int,text:string,v:string,s:double>")
_REF = "struct<title:string,doi:string,year:int,authors:string,citations:bigint,s2:string>"
_SHAPES = {
    "reading": "map<string,struct<pages:map<string,struct<t:double,a:int>>,total:double,first:bigint,"
               "last:bigint,numPages:int>>",
    "rhythm": "map<string,struct<seconds:bigint,pages:bigint,annotations:bigint,items:array<string>>>",
    "review": "map<string,struct<key:string,attachmentID:bigint,itemID:bigint,due:bigint,step:int,"
              "lapses:bigint,reviews:bigint,lastGrade:string,added:bigint>>",
    "references": f"map<string,struct<at:bigint,refs:array<{_REF}>>>",
    "citations": "map<string,map<string,string>>",
    "ranks": "map<string,map<string,string>>",
    "translation-cache": "map<string,string>",
}


def _library(file) -> F.Column:
    """The folder above a file, bare of a partition's column name."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -2), "^library_id=", "")


def _maps(spark: SparkSession, path: str, kind: str) -> DataFrame:
    # values without brackets of their own are cut at commas
    flat = kind == "translation-cache"
    found = jsonmaps.entries(spark, path, separator="," if flat else "}")
    parsed = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), _SHAPES[kind])
    return found.select(_library("file").alias("library_id"), F.explode(parsed).alias("k", "v")).where("v is not null")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of index files, which hold one list, ``chunks``, beside plain fields."""
    found = jsonmaps.entries(spark, path, levels=(1, 2)).withColumn(
        "entry", F.regexp_replace("entry", r'^"chunks"\s*:\s*', ""))
    field = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), "model string, dims int")
    heads = found.where("entry not like '{%'").select("file", field.alias("h")).groupBy("file").agg(
        F.max("h.model").alias("model"), F.max("h.dims").alias("dims"))
    bodies = found.where("entry like '{%'").select("file", F.from_json("entry", _CHUNK).alias("c")).where("c.id is not null")
    return bodies.join(broadcast_if_small(cut_lineage(heads)), "file", "left").select(
        _library("file").alias("library_id"), "model", "dims", "c")


def _instant(ms: str):
    return F.timestamp_millis(ms)


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One snapshot kind as a table; the folder above each file names its library."""
    if kind != "index" and kind not in _SHAPES:
        raise ValueError(f"unknown snapshot kind {kind!r}")
    rows = _chunks(spark, path) if kind == "index" else _maps(spark, path, kind)
    if kind == "reading":
        return rows.select(
            "library_id", F.col("k").alias("attachment_key"),
            F.floor(F.col("v.total") * 10 + 0.5).alias("deciseconds"),
            _instant("v.first").alias("first"), _instant("v.last").alias("last"),
            F.coalesce("v.numPages", F.lit(0)).alias("num_pages"), F.col("v.pages").alias("pages"))
    if kind == "rhythm":
        return rows.select("library_id", F.to_date("k").alias("day"), "v.seconds", "v.pages",
                           "v.annotations", F.size("v.items").cast("bigint").alias("items"))
    if kind == "review":
        return rows.select(
            "library_id", F.col("k").alias("card_key"), F.col("v.attachmentID").alias("attachment_id"),
            F.col("v.itemID").alias("item_id"),
            F.date_add(F.lit("1970-01-01").cast("date"), F.col("v.due").cast("int")).alias("due"),
            "v.step", "v.lapses", "v.reviews", F.col("v.lastGrade").alias("last_grade"))
    if kind == "index":
        # one decoding a chunk: the bytes are a bound variable, not an expression repeated per code
        codes = F.transform(F.array(F.unbase64("c.v")), lambda raw: F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.conv(
            F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")))[0]
        signed = F.transform(codes, lambda b: F.when(b > 127, b - 256).otherwise(b).cast("tinyint"))
        return rows.select(
            "library_id", "model", "dims", F.col("c.id").alias("chunk_id"),
            F.col("c.itemKey").alias("item_key"), "c.title", "c.page", "c.text",
            F.when(F.length("c.v") > 0, signed).alias("codes"), F.col("c.s").alias("scale"))
    if kind == "references":
        return rows.select("library_id", F.col("k").alias("citing_key"),
                           _instant("v.at").alias("fetched_at"), F.explode("v.refs").alias("r")).select(
            "library_id", "citing_key", "fetched_at", "r.title", "r.doi", "r.year", "r.authors",
            "r.citations")
    if kind == "citations":
        return rows.select("library_id", F.col("k").alias("item_key"), F.col("v").alias("citation_record"))
    if kind == "ranks":
        return rows.select("library_id", F.col("k").alias("venue_key"), F.col("v").alias("record"))
    parts = F.split("k", ":", 3)
    return rows.select("library_id", parts[0].alias("engine"), parts[1].alias("lang"),
                       parts[2].alias("text_hash"), F.col("v").alias("value"))


def page_heat(reading: DataFrame) -> DataFrame:
    """Long form of a reading snapshot: tenths of a second per page."""
    return reading.select("library_id", "attachment_key", F.explode("pages").alias("page", "v")).select(
        "library_id", "attachment_key", F.col("page").cast("int").alias("page"), F.floor(F.col("v.t") * 10 + 0.5).alias("deciseconds"))


def reading_state(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """Entries ``k, v`` of a reading snapshot, from the tables of page and attachment heat.

    A value holds all pages of one attachment, as the file's format asks.  Attachments without totals have no entry.
    """
    page = F.struct(F.col("page").cast("string").alias("key"), F.struct(
        (F.col("deciseconds") / 10).alias("t"), F.lit(0).alias("a")).alias("value"))
    held = pages.groupBy("attachment_key").agg(F.map_from_entries(F.collect_list(page)).alias("pages"))
    value = F.struct("pages", (F.col("deciseconds") / 10).alias("total"), F.unix_millis("first").alias("first"),
                     F.unix_millis("last").alias("last"), F.col("num_pages").alias("numPages"))
    return totals.join(held, "attachment_key", "left").select(
        F.col("attachment_key").cast("string").alias("k"), F.to_json(value).alias("v"))


TICKS = ("tick_id bigint, reader_id bigint, attachment_key bigint, item_key bigint, page int, "
         "focused boolean, num_pages int, ts timestamp")


def ticks(spark: SparkSession, path: str, streaming: bool = False, form: str = "parquet",
          files_per_batch: int | None = None) -> DataFrame:
    """Reading ticks of a folder of poll logs, as a backfill or as a stream.

    Logs are Parquet files, or with ``form="json"`` one JSON object a line; a line that is no tick is left out.
    A stream takes the files in the order they landed, ``files_per_batch`` at a time (all that are new
    without it), and its checkpoint says where to go on; a new checkpoint replays the folder.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if form == "json":
        reader = reader.option("mode", "DROPMALFORMED").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")
    rows = reader.schema(TICKS).format(form).load(path)
    return rows.where("reader_id is not null and ts is not null")


def land_ticks(polled: DataFrame, path: str) -> None:
    """Append polled ticks to the folder's logs as one JSON file that streams take as a whole."""
    (polled.select(*[f.split()[0] for f in TICKS.split(", ")]).coalesce(1).write.mode("append")
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path))


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))
