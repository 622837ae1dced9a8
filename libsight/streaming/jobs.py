"""Streaming jobs over annotations, findings and new items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from libsight.functions import text as tx
from libsight.operators import review, transform, watch
from libsight.streaming import state as versions

_DECK = "card_key bigint, item_key bigint, due date, step int, lapses bigint, reviews bigint"
_SEEN = "watch_id string, finding_id string, seen_at timestamp"
_RUN = "watch_id string"
_CACHE = "engine string, lang string, text_hash string, value string"


def first_sightings(annotations: DataFrame, late: str = "1 day") -> DataFrame:
    """Each annotation once, however often its source repeats it within the watermark."""
    return annotations.withWatermark("ts", late).dropDuplicatesWithinWatermark(["annotation_key"])


def enrol_batches(out: str, state: str, today: str | None = None, deck_schema: str = _DECK) -> versions.BatchFn:
    """``foreachBatch`` function: cards for annotations no earlier batch enrolled.

    ``today`` is the day each batch runs unless it is given.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        deck = versions.read(batch.sparkSession, state, batch_id, deck_schema)
        day = today or str(batch.sparkSession.range(1).select(F.current_date()).first()[0])
        cards = review.enrol(batch, deck, day).persist()
        versions.emit(cards, out, batch_id)
        columns = deck.columns
        versions.write(deck.unionByName(cards.select(*columns)), state, batch_id)
        cards.unpersist()
    return run


def alert_batches(out: str, state: str, memory: int = watch.MEMORY, seen_schema: str = _SEEN,
                  run_schema: str = _RUN) -> versions.BatchFn:
    """``foreachBatch`` function: findings new to their watch; a watch's first run is its baseline.

    A row with a null ``finding_id`` says that its watch ran, so a first run that finds nothing
    is a baseline as well.
    The seen ids of all watches are one table joined per batch, so a watch with
    very many findings is no single group.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs = batch.dropDuplicates(["watch_id", "finding_id"]).persist()
        found = runs.where("finding_id is not null")
        seen = versions.read(spark, f"{state}/seen", batch_id, seen_schema)
        ran = versions.read(spark, f"{state}/ran", batch_id, run_schema)
        versions.emit(watch.alerts(found, seen, ran), out, batch_id)
        added = watch.unseen(found, seen)
        versions.write(watch.remember(seen, added, memory), f"{state}/seen", batch_id)
        versions.write(ran.unionByName(runs.select("watch_id")).distinct(), f"{state}/ran", batch_id)
        runs.unpersist()
    return run


def translate_batches(out: str, engines: Sequence[transform.Engine], chosen: str, lang: str,
                      cache: str | None = None) -> versions.BatchFn:
    """``foreachBatch`` function: titles and abstracts of new items that have an abstract.

    ``cache`` is a folder of translations (``engine, lang, text_hash, value``): texts found there
    are not sent out, and each batch adds what it translated.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        ready = batch.where(tx.strip(F.coalesce("abstract", F.lit(""))) != "").persist()
        if not ready.isEmpty():
            spark = batch.sparkSession
            texts = transform.metadata_texts(ready)
            known = versions.read_parts(spark, cache, batch_id, _CACHE) if cache else None
            results = transform.translate_texts(transform.distinct_texts(texts), engines, chosen, lang, known)
            versions.emit(transform.metadata_table(transform.attach(texts, results)), out, batch_id)
            if cache:
                versions.emit(transform.cache_rows(results, lang), cache, batch_id)
        ready.unpersist()
    return run
