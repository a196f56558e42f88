"""Places in a global order, and running sums along it, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepairs.functions.frames import quoted
from tracepairs.sources.stages import staged


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """``df`` with the sums (of integers) over all rows before each one in ``order``, within equal ``by``.

    Rows are put in ranges of the order, each range is summed, and the sums of earlier ranges are added, so that neither a
    frequent value of ``by`` nor equal values of the order make one task large. ``order`` tells all rows apart that shall
    have a fixed place; ``by`` is not null.
    """
    keys = [quoted(c) for c in by]
    ranged = staged(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    local = ranged.groupBy("__part", *keys).agg(*[F.sum(x).alias(f"__{k}") for k, x in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = local.select("__part", *keys, *[F.coalesce(F.sum(quoted(f"__{k}")).over(earlier), F.lit(0)).alias(f"__{k}") for k in sums])
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumns({k: F.coalesce(F.sum(x).over(inside), F.lit(0)) for k, x in sums.items()})
    out = within.join(offsets, ["__part", *by])
    return out.select(*[quoted(c) for c in df.columns if c not in sums], *[(quoted(k) + quoted(f"__{k}")).cast("long").alias(k) for k in sums])


def ranked(df: DataFrame, order: list[Column], name: str = "rank", by: list[str] = ()) -> DataFrame:
    """``df`` with its place in ``order``, from 1 without gaps, within equal ``by``."""
    return running_sums(df, order, {name: F.lit(1)}, by).withColumn(name, quoted(name) + 1)
