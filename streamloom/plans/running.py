"""Running sums, counts and maxima that no long key makes one task's work.

A plain window sorts all rows of a key in one task. Here a key's rows are cut into chunks by a
column that rises with the order, scanned chunk by chunk, and the chunks' totals, few rows
for each key, are scanned in turn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of an order column that fall in one chunk.
CHUNK = 1_000_000


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column, bool]], chunk: int = CHUNK) -> DataFrame:
    """df with a column for each of values: name -> ("sum" | "max", column, whether the row itself counts).

    A null key is a key like any other. order must be an integer column, unique within a key; rows where it
    is null come first, in one chunk. Sums of nothing are 0, maxima of nothing null.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    within = Window.partitionBy(*keys, "_chunk").orderBy(order)
    aggregate = {"sum": F.sum, "max": F.max}
    local = cut
    for name, (kind, value, own) in values.items():
        frame = within.rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
        local = local.withColumn(f"_l_{name}", aggregate[kind](value).over(frame))
    totals = cut.groupBy(*keys, "_chunk").agg(*[aggregate[kind](value).alias(f"_t_{name}") for name, (kind, value, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_chunk", *[aggregate[kind](f"_t_{name}").over(earlier).alias(f"_b_{name}") for name, (kind, _, _) in values.items()])
    same = [local[k].eqNullSafe(before[k]) for k in (*keys, "_chunk")]
    joined = local.join(before, reduce(Column.__and__, same)).select(*[local[c] for c in local.columns], *[before[f"_b_{n}"] for n in values])
    whole = {
        name: F.coalesce(f"_l_{name}", F.lit(0)) + F.coalesce(f"_b_{name}", F.lit(0)) if kind == "sum" else F.greatest(f"_l_{name}", f"_b_{name}")
        for name, (kind, _, _) in values.items()
    }
    return joined.select(*df.columns, *[c.alias(n) for n, c in whole.items()])
