"""Callable transforms over tables: model map, embedding map, cached engine chain.

The callables are the user's; here they run inside tasks, batch by batch.  Their
results cost money and need not repeat, so anything reused is first written out
or checkpointed, never recomputed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from libsight.functions import text as tx
from libsight.functions.ordered import skew_join
from libsight.session import cut_lineage

TextFn = Callable[[list[str]], list[str]]
EMBED_BATCH = 16
# Causes that fail every further call to an engine the same way.
FATAL_KINDS = ("auth", "quota", "address", "model", "unreachable", "certificate")
FATAL_TEXT = re.compile(r"40[13]|unauthor|invalid", re.I)


class EngineError(Exception):
    """A failed call with a known cause."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


def is_fatal(error: Exception) -> bool:
    return getattr(error, "kind", None) in FATAL_KINDS or bool(FATAL_TEXT.search(str(error)))


def _groups(values: Sequence, size: int) -> Iterator[Sequence]:
    for start in range(0, len(values), size):
        yield values[start:start + size]


#: Rows sent back at a time: a whole Arrow batch with its answers beside it takes several times its bytes.
ROWS_BACK = 256


def _parts(batches: Iterator[pd.DataFrame], batch: int) -> Iterator[pd.DataFrame]:
    """Arrow batches in parts of whole calls."""
    for frame in batches:
        yield from _groups(frame, batch * max(1, ROWS_BACK // batch))


# --- model map

def model_map(df: DataFrame, fn: TextFn, prompt: str, model: str = "", prompt_id: str | Column = "",
              batch: int = 1, tasks: int | None = None, keep: bool = True) -> DataFrame:
    """One answer per row; a failing row carries its error instead of failing the job.

    Adds ``answer, error, model, prompt_id, answered_at``.  ``tasks`` sets how
    many calls run at once.  A failing batch is retried row by row.  ``keep``
    checkpoints the answers, so that later steps do not call the model again.
    """
    rows = df.repartition(tasks) if tasks else df
    out = T.StructType([*df.schema.fields, T.StructField("answer", T.StringType()),
                        T.StructField("error", T.StringType())])

    def one_by_one(texts: list[str]) -> Iterator[tuple[str | None, str | None]]:
        for text in texts:
            try:
                yield fn([text])[0], None
            except Exception as error:  # the row's status, by contract
                yield None, str(error) or type(error).__name__

    def ask(texts: list[str]) -> list[tuple[str | None, str | None]]:
        if len(texts) > 1:
            try:
                answers = fn(texts)
                if len(answers) == len(texts):
                    return [(a, None) for a in answers]
            except Exception:  # found out row by row below
                pass
        return list(one_by_one(texts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _parts(batches, batch):
            done = [pair for group in _groups(frame[prompt].tolist(), batch) for pair in ask(group)]
            yield frame.assign(answer=[a for a, _ in done], error=[e for _, e in done])

    done = rows.mapInPandas(run, out).withColumns({
        "model": F.lit(model), "prompt_id": F.lit(prompt_id), "answered_at": F.current_timestamp()})
    return cut_lineage(done) if keep else done


def landed(df: DataFrame, path: str) -> DataFrame:
    """Write answers out and read them back, so no call is ever repeated."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


# --- embedding map

def embed(chunks: DataFrame, fn: Callable[[list[str]], list[list[float]]],
          batch: int = EMBED_BATCH, tolerant: bool = True, keep: bool = True) -> DataFrame:
    """Adds ``embedding``; batches of ``batch`` texts, order kept, vectors checkpointed.

    A batch that fails or returns another number of vectors leaves its rows
    without vectors when ``tolerant``, else fails the job.
    """
    out = T.StructType([*chunks.schema.fields,
                        T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def vectors_of(texts: list[str]) -> list[list[float] | None]:
        try:
            found = fn(texts)
            if len(found) != len(texts):
                raise ValueError("unexpected number of vectors")
            return found
        except Exception:
            if not tolerant:
                raise
            return [None] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _parts(batches, batch):
            yield frame.assign(embedding=[
                v for group in _groups(frame["text"].tolist(), batch) for v in vectors_of(group)])

    done = chunks.mapInPandas(run, out)
    return cut_lineage(done) if keep else done


# --- cached engine chain

@dataclass(frozen=True)
class Engine:
    """A text engine: its name, batch size and whether it may stand in for others."""

    name: str
    fn: TextFn
    batch: int = 1
    ready: bool = True
    fallback: bool = True


def cache_lookup(texts: DataFrame, cache: DataFrame, engine: str, lang: str) -> DataFrame:
    """Distinct texts (``text_hash, text``) with their cached ``value`` or NULL."""
    own = cache.where((F.col("engine") == engine) & (F.col("lang") == lang)).select(
        "text_hash", "value").dropDuplicates(["text_hash"])
    return texts.join(own, "text_hash", "left")


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Every non-blank text once, with its key."""
    return (df.where(tx.strip(text) != "").select(F.col(text).alias("text")).distinct()
            .select(tx.text_key("text").alias("text_hash"), "text"))


_REPLIES = "text_hash string, text string, value string, error string, fatal boolean"
#: Ends of the waves in 64ths of the texts.
_WAVES = (4, 64)


def run_engine(pending: DataFrame, engine: Engine) -> DataFrame:
    """``text_hash, text, value, error`` of one engine; '' where it gave nothing.

    Entries missing at a reply's end count as empty; a reply with surplus entries fails its
    batch.  A fatal cause ends the engine for the rest of the task's rows, whose ``fatal`` is set.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fatal: str | None = None
        for frame in _parts(batches, engine.batch):
            values: list[str] = []
            errors: list[str | None] = []
            for group in _groups(frame["text"].tolist(), engine.batch):
                got, why = [""] * len(group), fatal
                if fatal is None:
                    try:
                        reply = list(engine.fn(list(group)))
                        if len(reply) > len(group):  # which entry is whose is not known
                            raise ValueError(f"{len(reply)} replies to {len(group)} texts")
                        got = [v or "" for v in reply] + [""] * (len(group) - len(reply))
                    except Exception as error:  # soft failures go on to the next engine
                        why = str(error) or type(error).__name__
                        fatal = why if is_fatal(error) else None
                values += got
                errors += [None if v else (why or "empty reply") for v in got]
            yield pd.DataFrame({"text_hash": frame["text_hash"], "text": frame["text"],
                                "value": values, "error": errors, "fatal": fatal is not None})

    return pending.select("text_hash", "text").mapInPandas(run, _REPLIES)


def run_in_waves(pending: DataFrame, engine: Engine) -> DataFrame:
    """As ``run_engine``, checkpointed, with a stop for the whole engine.

    One batch of texts is the probe; growing waves of the others follow.  A wave starts only if
    those before met no fatal cause, so an engine that is dead gets the probe, and one that
    dies later the calls of its wave, however many tasks there are.  Texts not sent have the cause
    as ``error``.  ``pending`` is read once a wave and should be checkpointed.
    """
    pending = pending.select("text_hash", "text")
    first = pending.orderBy("text_hash").limit(engine.batch)
    probed = cut_lineage(run_engine(first.coalesce(1), engine))
    place = F.pmod(F.xxhash64("text_hash"), F.lit(_WAVES[-1]))
    # a batch of text hashes
    rest = pending.join(F.broadcast(probed.select("text_hash")), "text_hash", "left_anti")
    out, cause, start = probed, _cause(probed), 0
    for end in _WAVES:
        if cause is not None:
            return out.unionByName(rest.where(place >= start).select(
                "text_hash", "text", F.lit("").alias("value"), F.lit(cause).alias("error"), F.lit(True).alias("fatal")))
        replies = cut_lineage(run_engine(rest.where((place >= start) & (place < end)), engine))
        out, cause, start = out.unionByName(replies), _cause(replies), end
    return out


def _cause(replies: DataFrame) -> str | None:
    """Why the engine is dead; None while it answers."""
    row = replies.where("fatal and error is not null").agg(F.min("error")).first()
    return row[0]


def fallback_order(engines: Sequence[Engine], chosen: str) -> list[Engine]:
    return [e for e in engines if e.name != chosen and e.fallback and e.ready]


def translate_texts(texts: DataFrame, engines: Sequence[Engine], chosen: str, lang: str,
                    cache: DataFrame | None = None, fallback: bool = True) -> DataFrame:
    """Cached transform of distinct texts through the chosen engine, then its stand-ins.

    Result: ``text_hash, text, value, engine, error, cached``; ``value`` is NULL
    where every engine failed.  Each engine's replies are checkpointed before
    the next one runs on what is left.  Raises where nothing at all could be done.
    """
    first = next(e for e in engines if e.name == chosen)
    if cache is not None:
        looked = cache_lookup(texts, cache, chosen, lang)
    else:
        looked = texts.withColumn("value", F.lit(None).cast("string"))
    looked = cut_lineage(looked)
    hits = looked.where("value is not null").select(
        "text_hash", "text", "value", F.lit(chosen).alias("engine"),
        F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    pending, out, replies = looked.where("value is null"), hits, None
    for engine in [first] + (fallback_order(engines, chosen) if fallback else []):
        replies = run_in_waves(pending, engine)
        done = replies.where("value <> ''")
        out = out.unionByName(done.select("text_hash", "text", "value", F.lit(engine.name).alias("engine"),
                                          "error", F.lit(False).alias("cached")))
        pending = replies.where("value = ''")
        if pending.isEmpty():
            return out
    if out.isEmpty():
        raise EngineError("failed", "no engine returned a result")
    return out.unionByName(pending.select(
        "text_hash", "text", F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("engine"), "error", F.lit(False).alias("cached")))


def cache_rows(results: DataFrame, lang: str) -> DataFrame:
    """New cache entries, filed under the engine that produced them."""
    return results.where("value is not null and not cached").select(
        "engine", F.lit(lang).alias("lang"), "text_hash", "value")


def incomplete(results: DataFrame) -> DataFrame:
    """How many texts no engine could do, and one of the reasons."""
    return results.where("value is null").agg(
        F.count("*").alias("missing"), F.min("error").alias("reason"))


def attach(df: DataFrame, results: DataFrame, text: str = "text", name: str = "translated") -> DataFrame:
    """Results back on every row; a text that fills much of the table is spread out."""
    keyed = df.withColumn("text_hash", tx.text_key(text))
    values = results.select("text_hash", F.col("value").alias(name))
    return skew_join(keyed, values, ["text_hash"], "left").drop("text_hash")


def translate(df: DataFrame, engines: Sequence[Engine], chosen: str, lang: str,
              cache: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The whole chain for a table: distinct, cache, engines, join back."""
    results = translate_texts(distinct_texts(df, text), engines, chosen, lang, cache)
    return attach(df, results, text)


# --- metadata, pairs, enrichment

def metadata_texts(items: DataFrame) -> DataFrame:
    """Title and tag-free abstract of each item as rows ``item_key, field, text``."""
    fields = F.array(
        F.struct(F.lit("title").alias("field"), F.coalesce("title", F.lit("")).alias("text")),
        F.struct(F.lit("abstract").alias("field"), tx.strip_html("abstract").alias("text")))
    return items.select("item_key", F.explode(fields).alias("f")).select("item_key", "f.*")


def metadata_table(translated: DataFrame) -> DataFrame:
    """One row per item: translated title and abstract; items with neither drop."""
    def of(field: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("field") == field, F.col("translated"))), F.lit(""))
    wide = translated.groupBy("item_key").agg(of("title").alias("title_translated"),
                                              of("abstract").alias("abstract_translated"))
    return wide.where("title_translated <> '' or abstract_translated <> ''")


def append_abstract(abstract: Column | str, translated: Column | str,
                    label: str = "translated") -> Column:
    """Abstract with the translation appended, unless it is in there already."""
    current, new = F.coalesce(tx.col(abstract), F.lit("")), F.coalesce(tx.col(translated), F.lit(""))
    add = (new != "") & ~F.contains(current, new)
    return F.when(add, F.concat(current, F.lit(f"\n\n【{label}】"), new)).otherwise(current)


def append_title(extra: Column | str, translated: Column | str, prefix: str = "lib") -> Column:
    """Free-text field with a title line added once."""
    current = F.coalesce(tx.col(extra), F.lit(""))
    line = F.concat(F.lit(f"{prefix}-title: "), tx.col(translated))
    return (F.when(F.contains(current, F.lit(f"{prefix}-title:")), current)
            .when(current == "", line).otherwise(F.concat(current, F.lit("\n"), line)))


def align_pairs(original: Column | str, translated: Column | str, sentences: bool = True) -> Column:
    """Array of (original, translated): by sentence where both sides split alike, else whole."""
    left, right = tx.col(original), tx.col(translated)
    whole = F.array(F.struct(left.alias("original"), right.alias("translated")))
    if not sentences:
        return whole
    a, b = tx.split_sentences(left), tx.split_sentences(right)
    pairs = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: F.struct(
        z["x"].alias("original"), z["y"].alias("translated")))
    return F.when((F.size(a) >= 2) & (F.size(a) == F.size(b)), pairs).otherwise(whole)


def bilingual_pairs(paragraphs: DataFrame, sentences: bool = True) -> DataFrame:
    """Rows of original and translated text per paragraph or sentence, with the page."""
    keep = [c for c in paragraphs.columns if c not in ("text", "translated")]
    return (paragraphs.where(F.coalesce("translated", F.lit("")) != "")
            .select(*keep, F.posexplode(align_pairs("text", "translated", sentences)).alias("pair_no", "p"))
            .select(*keep, "pair_no", "p.original", "p.translated"))


def explained(annotations: DataFrame, answers: DataFrame, label: str = "explained") -> DataFrame:
    """Comment of each annotation with its set's explanation appended (``set_id, answer``)."""
    comment = F.coalesce("comment", F.lit(""))
    joined = skew_join(annotations, answers.select("set_id", "answer"), ["set_id"], "left")
    return joined.withColumn("comment", F.when(F.col("answer").isNotNull(), tx.strip(F.concat(
        comment, F.lit(f"\n\n[{label}] "), "answer"))).otherwise(comment)).drop("answer")


def with_translation(annotations: DataFrame) -> DataFrame:
    """Comment of each annotation with the translation of its passage appended."""
    comment = F.coalesce("comment", F.lit(""))
    return annotations.withColumn("comment", F.when(
        F.coalesce("translated", F.lit("")) != "",
        tx.strip(F.concat(comment, F.lit("\n"), "translated"))).otherwise(comment)).drop("translated")


def passage() -> Column:
    """What an annotation offers to translate: its text, else its comment."""
    return F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("comment"), F.lit(""))
