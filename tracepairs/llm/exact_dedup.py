"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one counts one 60-bit hash of each row's normalised text, combined map-side, and puts the hashes that occur again
into a blocked Bloom filter: a hash chooses a block of 32,768 cells and two cells in it, and blocks are packed into
4 KB bitmaps by Spark's bitmap aggregates. Pass two looks the cells of each row up in the broadcast bitmaps. A row with
a cell that is not set has a text that no other row has and passes straight through; only the other rows (the copies,
and a few false positives) shuffle.

What shuffles for a row with a text of its own is thus its (hash, count) of pass one, and nothing else.
The filter grows with the hashes that occur again, by ``cells_per_hash`` each. Above ``max_cells`` (2**30 cells are
128 MB) it is cut by ranges of blocks, and pass two runs once for each range, over the rows of that range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracepairs.llm.common import SPACE_CLASS, join_hot, materialize, quoted

RESULT = ["keep_id", "group_size", "kept", "text_sha256"]
_BLOCK_BITS = 15  # cells in one bitmap of Spark's bitmap functions, as a power of two


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", " ")


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text), 256)


def _hash(digest: Column) -> Column:
    """60 bits of the digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _is_set(bits: Column, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(cell, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, cell.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def mark_possible_repeats(rows: DataFrame, hashes: DataFrame, *, cells_per_hash: int = 16, max_cells: int = 1 << 30) -> DataFrame:
    """``rows`` (with ``h``) with ``possible``: false only where no other row of ``hashes`` (h) has the same hash."""
    again = materialize(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated")
    wanted = max(1, again.count() * cells_per_hash) >> _BLOCK_BITS
    block_bits = min(30, wanted.bit_length())  # 2**30 blocks: the hash has no bits for more
    ranges = max(1, (1 << (block_bits + _BLOCK_BITS)) // max_cells)
    block = F.col("h").bitwiseAND(F.lit((1 << block_bits) - 1))
    cells = [F.shiftright("h", block_bits + k * _BLOCK_BITS).bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)) for k in (0, 1)]
    part = F.pmod(block, F.lit(ranges))
    bitmaps = again.select(block.alias("block"), part.alias("part"), F.explode(F.array(*cells)).alias("cell")).groupBy("part", "block")
    # position p of a bitmap is p // 8 bytes from its start
    bitmaps = bitmaps.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell + 1))").alias("bits"))
    bitmaps = materialize(bitmaps, "bitmaps")
    both = _is_set(F.col("__f.bits"), cells[0]) & _is_set(F.col("__f.bits"), cells[1])
    packed = F.struct("block", "bits").alias("__f")

    def one(r: int) -> DataFrame:
        own = F.broadcast(bitmaps.where(F.col("part") == r).select(packed))  # at most max_cells / 8 bytes
        return rows.where(part == r).join(own, block == F.col("__f.block"), "left").select(*rows.columns, both.alias("possible"))

    return reduce(DataFrame.unionByName, map(one, range(ranges)))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bloom: int) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms are; the row with the smallest id stays. Null and empty
    texts are one group, white-space-only texts another (a single space). Rows that repeat the smallest id
    of their group are all ``kept``. A null id is never preferred to another one; in a group of nothing but
    null ids, ``keep_id`` is null and all its rows are kept. An empty table gives an empty result.
    """
    digest = text_digest(quoted(text_col)).alias("text_sha256")
    digests = materialize(df.select(quoted(id_col).alias("id"), digest), "digests").withColumn("h", _hash(F.col("text_sha256")))
    flagged = mark_possible_repeats(digests, digests.select("h"), **bloom).drop("h")
    once = flagged.where(~F.col("possible")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    again = flagged.where("possible").select("id", "text_sha256")
    groups = again.groupBy("text_sha256").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = join_hot(again, materialize(groups, "groups"), ["text_sha256"], "group_size")
    joined = joined.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return once.unionByName(joined).withColumnRenamed("id", id_col)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bloom: int) -> DataFrame:
    """The rows of ``df`` that stay, with their columns, whatever their names. Rows with a text of their own do not
    shuffle.

    Of each group of equal texts one row stays, with the smallest id (null last). Rows that repeat both id and
    text stay once; their other columns come from one of them.
    """
    row = F.struct(*map(quoted, df.columns)).alias("row")
    rows = df.select(row, quoted(id_col).alias("id"), text_digest(quoted(text_col)).alias("text_sha256")).withColumn("h", _hash(F.col("text_sha256")))
    flagged = mark_possible_repeats(rows, materialize(rows.select("h"), "hashes"), **bloom)
    first = flagged.where("possible").groupBy("text_sha256").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id")).alias("row"))
    return flagged.where(~F.col("possible")).select("row").unionByName(first.select("row")).select("row.*")
