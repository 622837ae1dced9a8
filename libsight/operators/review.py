"""Spaced review from an append-only log ``card_key, ts, review_id, grade``.

Grades: again, good, easy; further events: enrol, bury, forget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from libsight.functions.ordered import skew_join

LADDER = (1, 3, 7, 16, 35, 90)
MIN_CHARS = 25
BURY_DAYS = 30


def parse_ladder(setting: str) -> tuple[int, ...]:
    """Positive numbers of a comma list; at least one is needed."""
    steps = tuple(int(p) for p in (s.strip() for s in setting.split(","))
                  if p.lstrip("-").isdigit() and int(p) > 0)
    if not steps:
        raise ValueError("the review ladder needs at least one positive interval")
    return steps


def reviewable() -> Column:
    """Text, else comment, long enough to review."""
    chosen = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("comment"), F.lit(""))
    return F.length(chosen) >= MIN_CHARS


def enrol(annotations: DataFrame, deck: DataFrame, today: str) -> DataFrame:
    """Cards for annotations the deck lacks, due tomorrow."""
    fresh = annotations.where(reviewable()).join(
        deck.select(F.col("card_key").alias("annotation_key")), "annotation_key", "left_anti")
    zero = F.lit(0).cast("long")
    return fresh.dropDuplicates(["annotation_key"]).select(
        F.col("annotation_key").alias("card_key"), "item_key",
        F.date_add(F.lit(today).cast("date"), 1).alias("due"),
        F.lit(0).alias("step"), zero.alias("lapses"), zero.alias("reviews"))


def deck_state(log: DataFrame, ladder: Sequence[int] = LADDER) -> DataFrame:
    """Current cards: ``card_key, due, step, lapses, reviews, last_grade``.

    Closed form of the review fold.  A first aggregate finds, per card, the last
    enrol, forget and "again"; the second sums what came after them.  Both are
    ordinary partial aggregates, so no card's log is sorted in one task.
    """
    steps = list(ladder)
    if not steps:
        raise ValueError("the review ladder needs at least one positive interval")
    at = F.struct("ts", "review_id")

    def last(grade: str) -> Column:
        return F.max(F.when(F.col("grade") == grade, at))

    marks = log.groupBy("card_key").agg(
        last("enrol").alias("_enrol"), last("forget").alias("_forget"),
        last("again").alias("_again"))
    alive = marks.where("_forget is null or _enrol > _forget")
    events = (skew_join(log, alive.select("card_key", "_enrol", "_again"), ["card_key"])
              .where(F.col("_enrol").isNull() | (at >= F.col("_enrol"))))
    graded = F.col("grade").isin("again", "good", "easy")
    climbs = F.when(F.col("_again").isNull() | (at > F.col("_again")),
                    F.when(F.col("grade") == "easy", 2).when(F.col("grade") == "good", 1))
    moves = F.when(graded | F.col("grade").isin("bury", "enrol"), at)
    folded = events.groupBy("card_key").agg(
        F.coalesce(F.sum(climbs), F.lit(0)).alias("_climb"),
        F.count_if(F.col("grade") == "again").alias("lapses"),
        F.count_if(graded).alias("reviews"),
        F.max_by(F.struct("grade", F.to_date("ts").alias("day")), moves).alias("_last"),
        F.max_by("grade", F.when(graded, at)).alias("last_grade"))
    step = F.least(F.lit(len(steps) - 1), F.col("_climb")).cast("int")
    interval = (F.when(F.col("_last.grade").isin("again", "enrol"), F.lit(1))
                .when(F.col("_last.grade") == "bury", F.lit(BURY_DAYS))
                .otherwise(F.array(*[F.lit(s) for s in steps])[step]))
    return folded.select("card_key", F.date_add("_last.day", interval).alias("due"),
                         step.alias("step"), "lapses", "reviews", "last_grade")


def due_cards(deck: DataFrame, annotations: DataFrame, items: DataFrame, today: str,
              most: int = 12) -> DataFrame:
    """Oldest due first, then least reviewed; cards without annotation or item drop."""
    due = deck.where(F.col("due") <= F.lit(today).cast("date"))
    return (due.join(annotations.withColumnRenamed("annotation_key", "card_key"), "card_key")
            .join(items, "item_key").orderBy("due", "reviews", "card_key").limit(most))


def deck_stats(deck: DataFrame, today: str) -> DataFrame:
    return deck.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("due") <= F.lit(today).cast("date")).alias("due"),
        F.count_if(F.col("step") >= 3).alias("mature"),
        F.coalesce(F.sum("lapses"), F.lit(0)).alias("lapses"))


def forget(deck: DataFrame, cards: DataFrame) -> DataFrame:
    return deck.join(cards.select("card_key").distinct(), "card_key", "left_anti")
