"""Watches over new papers: registry, unseen findings, seen memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from libsight.functions.ordered import top_per_group
from libsight.functions.text import strip

MEMORY = 400


def add_item_watches(watches: DataFrame, items: DataFrame) -> DataFrame:
    """One citation watch per item not yet watched."""
    fresh = (items.dropDuplicates(["item_key"])
             .join(watches.where("item_key is not null").select("item_key"), "item_key", "left_anti"))
    rows = fresh.select(
        F.concat(F.lit("w"), F.col("item_key").cast("string")).alias("watch_id"),
        F.lit("citations").alias("kind"),
        F.concat("citation", F.lit(" — "), F.substring("title", 1, 60)).alias("label"),
        "item_key", F.lit(None).cast("string").alias("query"))
    return watches.unionByName(rows)


def add_query_watches(watches: DataFrame, queries: DataFrame, kind: str = "arxiv") -> DataFrame:
    """One watch per query text; blank queries are ignored."""
    text = strip("query")
    rows = queries.where(text != "").select(
        F.concat(F.lit("w"), F.sha2(F.concat_ws("|", F.lit(kind), text), 256)).alias("watch_id"),
        F.lit(kind).alias("kind"), text.alias("label"),
        F.lit(None).cast(watches.schema["item_key"].dataType).alias("item_key"),
        text.alias("query"))
    return watches.unionByName(rows)


def remove_watches(watches: DataFrame, gone: DataFrame) -> DataFrame:
    return watches.join(gone.select("watch_id"), "watch_id", "left_anti")


def unseen(findings: DataFrame, seen: DataFrame) -> DataFrame:
    """Findings of a run that their watch has not shown before."""
    return findings.join(seen.select("watch_id", "finding_id"), ["watch_id", "finding_id"],
                         "left_anti").dropDuplicates(["watch_id", "finding_id"])


def alerts(findings: DataFrame, seen: DataFrame, already_run: DataFrame) -> DataFrame:
    """Unseen findings of watches that ran before; a first run only sets the baseline."""
    return unseen(findings, seen).join(already_run.select("watch_id"), "watch_id", "left_semi")


def remember(seen: DataFrame, added: DataFrame, memory: int = MEMORY) -> DataFrame:
    """Seen set after a run: the newest ``memory`` ids of each watch (``seen_at`` decides)."""
    both = seen.select("watch_id", "finding_id", "seen_at").unionByName(
        added.select("watch_id", "finding_id", "seen_at"))
    latest = both.groupBy("watch_id", "finding_id").agg(F.max("seen_at").alias("seen_at"))
    return top_per_group(latest, ["watch_id"], [F.col("seen_at").desc(), F.col("finding_id")],
                         memory)


def replay(findings: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """First day each finding was new to its watch, baseline day left out.

    The whole history of runs in one pass, for a memory that never fills up.  ``runs``
    (``watch_id, run_day``) also names runs that found nothing: the first run is the baseline
    whatever it found.
    """
    first = findings.groupBy("watch_id", "finding_id").agg(F.min("run_day").alias("run_day"))
    days = first.select("watch_id", "run_day")
    if runs is not None:
        days = days.unionByName(runs.select("watch_id", "run_day"))
    baseline = days.groupBy("watch_id").agg(F.min("run_day").alias("_first_run"))
    return (first.join(baseline, "watch_id").where("run_day > _first_run").drop("_first_run"))
