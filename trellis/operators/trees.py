"""Bottom-up evaluation of flat AND/OR trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUNCTIONS = ["all", "any", "and", "or"]


def tree_depth(nodes: DataFrame) -> int:
    """Depth of the deepest node (one aggregate; the only number a fold needs up front)."""
    return nodes.agg(F.max("depth")).first()[0] or 0


def above(kinds: str = "kinds") -> Column:
    """The junctions above a node as one character each: ``|`` for any/or, ``&`` for all/and."""
    return F.array_join(F.transform(kinds, lambda k: F.when(k.isin("any", "or"), "|").otherwise("&")), "")


def leaf_rows(nodes: DataFrame, *columns: str) -> DataFrame:
    """Leaves in the form :func:`fold` wants: ``columns``, ``path`` and ``above``."""
    return nodes.where(~F.col("kind").isin(*JUNCTIONS)).select(*columns, "path", above().alias("above"))


def fold(leaves: DataFrame, keys: list[str], value: str, any_of: Column, all_of: Column, depth: int, placed_by: list[str] | None = None) -> DataFrame:
    """Combine leaf values up to the roots: ``(keys..., path, value)``, one row per tree root.

    Level by level, leaves below a junction are grouped under the junction's path; shallower leaves
    pass through as groups of one.  All groupings refine ``keys``, so one shuffle on ``keys`` serves
    every level (on ``placed_by``, a part of ``keys``, if the caller groups by that next; none if that is
    empty because the leaves are placed already).  Duplicate leaf rows change nothing.
    """
    rows = leaves.select(*keys, "path", "above", value)
    if placed_by is None or placed_by:
        rows = rows.repartition(*(placed_by or keys))
    for level in range(depth, 0, -1):
        deep = F.length("above") >= level
        up = rows.select(
            *keys,
            F.when(deep, F.substring_index("path", ".", level)).otherwise(F.col("path")).alias("path"),
            F.when(deep, F.left("above", F.lit(level - 1))).otherwise(F.col("above")).alias("above"),
            F.when(deep, F.substring("above", level, 1)).otherwise("").alias("_junction"),
            value,
        )
        folded = F.when(F.col("_junction") == "|", any_of).when(F.col("_junction") == "&", all_of).otherwise(F.max(value))
        rows = up.groupBy(*keys, "path", "above", "_junction").agg(folded.alias(value)).drop("_junction")
    return rows.select(*keys, "path", value)
