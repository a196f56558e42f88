"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into buckets of bounded size by a seeded hash. Pass two puts each
bucket into the order of its hashes (so that retries agree), permutes it by a seeded Fisher-Yates shuffle and
writes it. The place in the whole shuffled sequence (rows of earlier buckets plus the place in the bucket)
then deals the records out: shards take turns, so their counts differ by one at most and slots have no gaps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepairs.llm.common import carried, carried_columns, materialize, quoted, rename_clashes, with_row


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n): position i from the end swaps with one drawn from 0 to i."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = list(range(n))
    draws = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes the values of a row take; a null takes none."""
    sizes = [F.lit(0)]
    for f in df.schema:
        value, kind = quoted(f.name), f.dataType.typeName()
        if kind in ("array", "map", "struct"):
            value, kind = F.to_json(F.struct(value)), "string"
        sizes.append(F.coalesce(F.octet_length(value), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    return sum(sizes[1:], sizes[0]).cast("long")


def shuffled_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", *, seed: int = 7, bucket_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (from 0 without gaps in each shard).

    Input columns of these names are replaced. The bucket of a record depends on the seed, its id and its text;
    null ids and texts are values like any other. ``bucket_bytes`` is the mean size of a bucket's rows, which
    a task holds in memory: copies spread by their ids, and only rows equal in id and text must share
    a bucket. An empty table gives an empty result. A rerun over the same rows gives the same shards and slots.
    """
    rows = rename_clashes(df, ["shard", "slot"])
    total = rows.agg(F.sum(row_bytes(rows) + 64)).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    h, order = (F.xxhash64(F.lit(seed + i), quoted(id_col), quoted(text_col)) for i in (0, 1))
    named = rows.select(carried(rows, rows.columns).alias("__row"), h.alias("__h"), order.alias("__order"))
    named = named.withColumn("__bucket", F.pmod(F.col("__h"), F.lit(n_buckets)))

    def permute(table: pa.Table) -> pa.Table:
        bucket = table.column("__bucket")[0].as_py()
        by_hash = np.lexsort((table.column("__h").to_numpy(), table.column("__order").to_numpy()))
        order = by_hash[fisher_yates(table.num_rows, (seed << 32) + bucket)]
        table = table.select(["__row", "__bucket"]).take(pa.array(order))
        return table.append_column("__place", pa.array(np.arange(table.num_rows, dtype=np.int64)))

    buckets = materialize(named.groupBy("__bucket").applyInArrow(permute, with_row(named, "__row", "__bucket long, __place long")), "buckets")
    counts = buckets.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket: this window grows with the bytes over bucket_bytes, not with the rows
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__bucket").alias("__of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    placed = buckets.join(F.broadcast(offsets) if n_buckets <= 500_000 else offsets, F.col("__bucket") == F.col("__of"))
    at = F.col("__before") + F.col("__place")
    return placed.select(*carried_columns(rows.columns, "__row"), F.pmod(at, F.lit(n_shards)).cast("int").alias("shard"), F.floor(at / n_shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=i`` each, rows by slot within a file; large shards are written by several tasks."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
