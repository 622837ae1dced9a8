"""Quality rules: native text statistics and a learned decision list.

Every statistic is a DataFrame expression over the whole text.  Sequential covering learns
the list from labelled statistics: each rule is a conjunction of thresholds, grown by
information gain on one part of the training rows and pruned on the other; what a rule
covers leaves the training rows.  All counting is done by Spark aggregates; the driver sees
one count per statistic, threshold and label.  The list becomes nested CASE WHEN.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from libsight.llm.classifier import held_out
from libsight.llm.texts import GAP, text_of
from libsight.session import cut_lineage

WINDOW_WORDS = 5
SYMBOLS = "[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics a rule may test.
TESTED = ("mean_word", "symbol_share", "pipe_share", "bang_share", "capital_share", "dup_line_share",
          "repeat_share", "double_share", "distinct_share", "n_words")


def _window_hashes(words: Column, n: Column) -> Column:
    """64-bit hashes of all windows of the text, in order."""
    zipped = F.arrays_zip(*[F.slice(words, i + 1, F.greatest(n, F.lit(1))).alias(str(i))
                            for i in range(WINDOW_WORDS)])
    return F.slice(F.transform(zipped, lambda w: F.xxhash64(w)), 1,
                   F.greatest(n - (WINDOW_WORDS - 1), F.lit(0)))


def statistics(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the counts ``BASE`` and the shares ``TESTED`` of every whole text.

    Null or empty texts have no words: all counts 0, shares 0.  Rows are measured one by one,
    so ties and repeated rows need no rule; other columns are dropped, and so is a kept column
    named like a statistic.  No shuffle, no Python.
    """
    made = {*BASE, *TESTED, "_text", "_words", "_lines", "_hashes", "_spots"}
    keep = tuple(c for c in keep if c not in made)
    df = documents.select(*[F.col(f"`{c}`") for c in keep], text_of().alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", GAP), ""))
    df = df.withColumn("n_words", F.size("_words").cast("bigint"))
    df = df.withColumn("_hashes", _window_hashes(F.col("_words"), F.col("n_words").cast("int")))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    # only texts in which a hash occurs twice are looked at closely: (hash, position) sorted, equal
    # neighbours are repeated windows, and each covers its words up to the next such window
    pairs = F.array_sort(F.arrays_zip(F.col("_hashes").alias("h"),
                                      F.sequence(F.lit(1), F.size("_hashes")).alias("p")))
    nothing = F.array().cast("array<int>")
    spots = F.array_sort(F.filter(
        F.transform(
            F.arrays_zip(pairs.alias("at"), F.slice(pairs, 2, F.size("_hashes")).alias("next"),
                         F.concat(F.array(F.lit(None)), pairs).alias("last")),
            lambda w: F.when((w["at"]["h"] == w["next"]["h"]) | (w["at"]["h"] == w["last"]["h"]),
                             w["at"]["p"])),
        lambda p: p.isNotNull()))
    repeats = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    df = df.withColumn("_spots", F.when(repeats, spots).otherwise(nothing))
    covered = F.aggregate(
        F.zip_with("_spots", F.slice("_spots", 2, F.greatest(F.size("_spots"), F.lit(1))),
                   lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS))),
        F.lit(0).cast("bigint"), lambda total, x: total + x)
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    df = (df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
          .withColumn("n_symbols", F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint"))
          .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
          .withColumn("n_repeat_words", covered)
          .withColumn("mean_word", F.col("word_chars") / n)
          .withColumn("symbol_share", F.col("n_symbols") / n)
          .withColumn("pipe_share", F.regexp_count("_text", F.lit(r"\|")) / n)
          .withColumn("bang_share", F.regexp_count("_text", F.lit("!")) / n)
          .withColumn("capital_share", F.regexp_count("_text", F.lit(r"\p{Lu}")) / chars)
          .withColumn("dup_line_share", F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)))
          .withColumn("repeat_share", F.col("n_repeat_words") / n)
          .withColumn("double_share", F.regexp_count("_text", F.lit(
              r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D])")) / n)
          .withColumn("distinct_share", F.size(F.array_distinct("_words")) / n))
    return df.select(*[F.col(f"`{c}`") for c in keep], *BASE, *[c for c in TESTED if c not in BASE])


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool      # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        value = F.col(self.name).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def conjunction(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The decision list: false where a rule fires, first rule first, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(conjunction(rule), F.lit(False)).otherwise(out)
    return out


def _binned(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """One row per training row and statistic: the number of thresholds below its value."""
    entries = [F.struct(F.lit(name).alias("name"),
                        sum((F.col(name).cast("double") > t).cast("int") for t in ts).alias("bin"))
               for name, ts in cuts.items() if ts]
    return rows.select("bad", F.inline(F.array(*entries)))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, steps: int = 24,
          min_covered: int = 8, precision: float = 0.9) -> list[Rule]:
    """Rules that find rows with ``bad`` true, from columns ``TESTED``, ``bad`` and ``prune``.

    Grown on rows with ``prune`` false, pruned on the others; candidate thresholds are
    quantiles over all growing rows.  A rule stands if it covers ``min_covered`` bad growing
    rows and is right in ``precision`` of what it covers in the pruning rows.  Ties go to the
    statistic listed first and the lower threshold.  Without bad rows the list is empty.
    """
    rows = cut_lineage(labelled.select(*TESTED, "bad", "prune"))
    levels = [i / steps for i in range(1, steps)]
    growing = rows.where(~F.col("prune"))
    # quantiles over all rows and over bad ones: rare faults lie beyond the common quantiles
    found = growing.agg(*[F.percentile_approx(F.when(test, F.col(c).cast("double")), levels, 2000)
                        .alias(f"{c}_{i}") for c in TESTED
                        for i, test in enumerate((F.lit(True), F.col("bad")))]).first()
    cuts = {c: sorted({x for i in (0, 1) for x in (found[f"{c}_{i}"] or [])}) for c in TESTED}
    if not any(cuts.values()):
        return []
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            counts: dict[str, dict[int, list[int]]] = {}
            scope = left.where(~F.col("prune")).where(conjunction(rule))
            for name, at, bad, count in (_binned(scope, cuts).groupBy("name", "bin", "bad")
                                         .count().collect()):
                counts.setdefault(name, {}).setdefault(at, [0, 0])[0 if bad else 1] += count
            if not counts:
                break
            first = next(iter(counts.values()))
            p0, n0 = (sum(c[i] for c in first.values()) for i in (0, 1))
            if not p0 or not n0 and rule:
                break
            best, chosen = 0.0, None
            for name in (c for c in TESTED if c in counts):
                p = n = 0
                for i, threshold in enumerate(cuts[name]):
                    p, n = (a + b for a, b in zip((p, n), counts[name].get(i, [0, 0])))
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        if pp >= min_covered and (gain := _gain(pp, nn, p0, n0)) > best + 1e-9:
                            best, chosen = gain, Condition(name, above, threshold)
            if chosen is None:
                break
            rule = (*rule, chosen)
        if not rule:
            break
        pruning = left.where("prune").agg(*[
            F.count(F.when(conjunction(rule[:k]) & (F.col("bad") == bad), 1)).alias(f"c{k}_{int(bad)}")
            for k in range(1, len(rule) + 1) for bad in (True, False)]).first()
        worth = []
        for k in range(1, len(rule) + 1):
            p, n = pruning[f"c{k}_1"], pruning[f"c{k}_0"]
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k))
        k = -max(worth)[1]
        p, n = pruning[f"c{k}_1"], pruning[f"c{k}_0"]
        if not p or p < precision * (p + n):
            break
        rules.append(rule[:k])
        left = left.where(~conjunction(rule[:k]))
    return rules


def judge(documents: DataFrame, labels: DataFrame, label: str = "quality",
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``BASE`` counts, ``base_failed`` and ``kept`` for every document.

    ``base_failed``: fewer than 10 words, or more than 20 % of words in repeated windows.
    ``kept``: false if that, else the verdict of the list learned from ``labels`` (null ids or
    labels are left out; of several labels of one id the greatest counts; ids that ``held_out``
    names are not learned from).  ``keep`` must hold ``doc_id``.  Statistics are computed once
    and checkpointed; only they meet the labels.
    """
    keep = tuple(c for c in keep if c not in (*BASE, *TESTED, "base_failed", "kept"))
    stats = cut_lineage(statistics(documents, keep))
    known = (labels.select(F.col("doc_id").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label"))
             .where("_id is not null and _label is not null").where(~held_out(F.col("_id")))
             .groupBy("_id").agg(F.max("_label").alias("_label")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    labelled = (stats.where(~failed).join(known, F.col("doc_id") == F.col("_id"))
                .withColumn("bad", F.col("_label") == 0)
                .withColumn("prune", F.pmod(F.xxhash64("_id"), F.lit(3)) == 0))
    rules = learn(labelled)
    return (stats.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & verdict(rules))
            .select(*[F.col(f"`{c}`") for c in keep], *BASE, "base_failed", "kept"))
