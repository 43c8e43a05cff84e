"""Ordered scans that do not need a whole key in one task.

A key's rows are cut into blocks of consecutive order values.  Windows run inside a block; what a
block hands to the next is one row per block, and only those rows are scanned per key.  A document
with a third of all lines is thus spread over as many tasks as it has blocks.

The rows are written before a scan, which reads them twice: what they are derived from, perhaps by an
earlier scan, is worked out once.  If all rows lie in one block nothing is handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.session import Staged

BLOCK = 8192


def _blocked(rows: DataFrame, order: str, block: int) -> tuple[DataFrame, bool]:
    """The rows, written, with their ``_block``; whether there is more than one block."""
    at = F.col("_block")
    store = Staged(rows.sparkSession)
    ends = [F.min(at).alias("low"), F.max(at).alias("high"), F.count(at).alias("placed")]
    seen = store.append(rows.withColumn("_block", F.floor(F.col(order) / block)), *ends)
    return store.last(), seen["low"] != seen["high"] or seen["placed"] != seen["rows"]


def carry(df: DataFrame, keys: list[str], order: str, events: dict[str, Column], inclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """For every row the last non-NULL event before it (or at it, if ``inclusive``) in its key.

    Wrap an event in a struct to carry "nothing" as a value: a NULL struct is no event, a struct of
    NULL is an event that clears.
    """
    named = {f"_e_{n}": e for n, e in events.items()}
    rows, many = _blocked(df.withColumns(named), order, block)
    part = [*keys, "_block"]
    inner = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumns({f"_l_{n}": F.last(f"_e_{n}", ignorenulls=True).over(inner) for n in events})
    if not many:
        return local.select(*df.columns, *[F.col(f"_l_{n}").alias(n) for n in events])
    tails = rows.groupBy(*part).agg(
        *[F.max_by(f"_e_{n}", F.when(F.col(f"_e_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}") for n in events]
    )
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*part, *[F.last(f"_t_{n}", ignorenulls=True).over(outer).alias(f"_c_{n}") for n in events])
    joined = local.join(carried, part, "left")
    return joined.select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in events])


def running_total(df: DataFrame, keys: list[str], order: str, amount: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Sum of ``amount`` over the rows strictly before each row of its key."""
    rows, many = _blocked(df.withColumn("_n", amount.cast("bigint")), order, block)
    part = [*keys, "_block"]
    inner = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_l", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    if not many:
        return local.select(*df.columns, F.col("_l").alias(name))
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*part).agg(F.sum("_n").alias("_s"))
    offsets = totals.select(*part, F.coalesce(F.sum("_s").over(outer), F.lit(0)).alias("_o"))
    return local.join(offsets, part, "left").select(*df.columns, (F.col("_l") + F.coalesce("_o", F.lit(0))).alias(name))
