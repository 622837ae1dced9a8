"""Relation graph: nodes, shared-tag links, explicit relations, edge merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F



def shared_tag_links(item_tags: DataFrame, items: DataFrame) -> DataFrame:
    """Links ``a < b`` between items sharing specific tags.

    A tag counts when 2 to min(25, max(3, 30 % of the items)) items carry it, so
    a tag yields at most 300 pairs and a hot tag none.  Frequency is counted
    before any pairing; the member list of a kept tag is at most 25 keys, and
    pairs are formed inside that list, without a self-join.
    """
    distinct = item_tags.select("item_key", "tag").distinct()
    # one-row total, attached through a constant key
    cap = items.agg(F.least(F.lit(25), F.greatest(
        F.lit(3), F.ceil(F.count("*") * 0.3))).alias("cap")).withColumn("_one", F.lit(1))
    frequency = (distinct.groupBy("tag").agg(F.count("*").alias("df"))
                 .where("df between 2 and 25")
                 .withColumn("_one", F.lit(1)).join(F.broadcast(cap), "_one")
                 .where("df <= cap").select("tag", "df"))
    members = (distinct.join(frequency, "tag").groupBy("tag", "df")
               .agg(F.array_sort(F.collect_list("item_key")).alias("m")))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(
        F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    share = (1 / F.log2(F.col("df") + 1)).alias("share")
    strength = (members.select(F.explode(pairs).alias("p"), share)
                .groupBy("p.a", "p.b").agg(F.sum("share").alias("strength")))
    return strength.select("a", "b", F.least(F.lit(1.6), F.col("strength") + 0.4).alias("weight"))


def relation_edges(items: DataFrame, related: str = "related") -> DataFrame:
    """Explicit relations with both ends present, weight 1.6."""
    present = items.select(F.col("item_key").alias("target"))
    return (items.select(F.col("item_key").alias("source"), F.explode(related).alias("target"))
            .where("source <> target").join(present, "target", "left_semi")
            .select("source", "target", F.lit("related").alias("kind"), F.lit(1.6).alias("weight")))


def merge_edges(*edge_sets: DataFrame) -> DataFrame:
    """One edge per unordered pair and kind; earlier sets win, no self-loops."""
    out = None
    for rank, edges in enumerate(edge_sets):
        part = edges.select("source", "target", "kind", F.col("weight").cast("double"),
                            F.lit(rank).alias("_rank"))
        out = part if out is None else out.unionByName(part)
    pair = out.where("source <> target").withColumns({
        "_a": F.least("source", "target"), "_b": F.greatest("source", "target")})
    chosen = pair.groupBy("_a", "_b", "kind").agg(
        F.min(F.struct("_rank", "source", "target", "weight")).alias("_e"))
    return chosen.select("_e.source", "_e.target", "kind", "_e.weight")


def nodes(items: DataFrame, item_tags: DataFrame) -> DataFrame:
    """Node weight grows with the number of tags."""
    counts = item_tags.groupBy("item_key").agg(F.count("*").alias("tags"))
    return items.join(counts, "item_key", "left").withColumn(
        "weight", 1 + F.coalesce("tags", F.lit(0)) * 0.3).drop("tags")


def graph_size(node_table: DataFrame, edges: DataFrame) -> DataFrame:
    n = node_table.agg(F.count("*").alias("nodes")).withColumn("_one", F.lit(1))
    e = edges.agg(F.count("*").alias("edges")).withColumn("_one", F.lit(1))
    return n.join(e, "_one").drop("_one")


def search_nodes(items: DataFrame, query: str,
                 columns: Sequence[str] = ("citation", "title", "short_title", "venue")) -> DataFrame:
    """Nodes whose label fields contain the text; blank finds none."""
    text = query.strip().lower()
    if not text:
        return items.where(F.lit(False))
    present = [F.coalesce(F.col(c), F.lit("")) for c in columns if c in items.columns]
    return items.where(F.contains(F.lower(F.concat_ws(" ", *present)), F.lit(text)))


