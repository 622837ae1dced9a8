"""Hierarchical tags: rollup, branch rename and delete, picking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _paths(tag: F.Column, prefix: str) -> F.Column:
    """Every prefix path of a nested tag, root first."""
    body = tag.substr(F.lit(len(prefix) + 1), F.length(tag))
    parts = F.filter(F.split(body, "/"), lambda p: p != "")
    paths = F.transform(parts, lambda p, i: F.concat(
        F.lit(prefix), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))
    return paths


def tag_tree(tags: DataFrame, prefix: str = "#") -> DataFrame:
    """Nodes (full, name, depth, parent, count); each distinct tag counts once per level."""
    distinct = tags.where(F.startswith("tag", F.lit(prefix))).select("tag").distinct()
    nodes = distinct.select(F.posexplode(_paths(F.col("tag"), prefix)).alias("depth", "full"))
    counted = nodes.groupBy("full", "depth").agg(F.count("*").alias("count"))
    return counted.select(
        "full",
        F.when(F.col("depth") == 0, F.expr(f"substring(full, {len(prefix) + 1})"))
        .otherwise(F.substring_index("full", "/", -1)).alias("name"),
        (F.col("depth") + 1).alias("depth"),
        F.when(F.col("depth") == 0, F.lit(""))
        .otherwise(F.regexp_replace("full", "/[^/]*$", "")).alias("parent"), "count")


def ordered_tree(tree: DataFrame) -> DataFrame:
    """Children by name within their parent."""
    return tree.orderBy("parent", "name")


def in_branch(tag: str, full: str) -> F.Column:
    return (F.col(tag) == full) | F.startswith(tag, F.lit(f"{full}/"))


def renamed_branch(full: str, leaf: str, prefix: str = "#") -> str | None:
    """New path of a branch; None where nothing changes.

    A top-level branch keeps the tag prefix, a deeper one its parent path.
    """
    clean = leaf.strip().replace("/", "")
    if not clean:
        return None
    parent, slash, _ = full.rpartition("/")
    new = (parent + slash if slash else prefix) + clean
    return None if new == full else new


def rename_branch(tags: DataFrame, full: str, leaf: str, prefix: str = "#") -> DataFrame:
    """Item tags after renaming a branch; a clash with an existing tag merges."""
    new = renamed_branch(full, leaf, prefix)
    if new is None:
        return tags
    moved = F.concat(F.lit(new), F.col("tag").substr(F.lit(len(full) + 1), F.length("tag")))
    return (tags.withColumn("tag", F.when(in_branch("tag", full), moved).otherwise(F.col("tag")))
            .dropDuplicates(["item_key", "tag"]))


def branch_tags(tags: DataFrame, full: str) -> DataFrame:
    """Number of distinct tags a rename or delete of the branch touches."""
    return tags.where(in_branch("tag", full)).agg(F.count_distinct("tag").alias("changed"))


def delete_branch(tags: DataFrame, full: str) -> DataFrame:
    return tags.where(~in_branch("tag", full))
