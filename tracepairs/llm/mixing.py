"""Mixing sources to target weights, in DataFrame functions only.

Each document gets a hash-random key. Within a source, keys are cut into equal key ranges (the random
order makes them equally full, so a source with a third of all rows is spread like any other), ranges are
summed, the sums of earlier ranges give each range its offset, and a running sum inside the range gives
each document the position of its words in the source's order. The source's budget then cuts that order
at the exact word, after as many whole repeats (epochs) as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepairs.llm.common import WORD_RE, materialize, quoted

RESULT = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def _running(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with running sums before each row in a global order: ``sums`` names the columns that they are of.

    Rows are sorted in ranges, ranges are summed, and the sums of earlier ranges are added: no task holds all rows.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    offsets = offsets.select("__part", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "__part")
    out = out.withColumns({k: (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__{k}")).cast("long") for k, c in sums.items()})
    return out.drop("__part", *[f"__{k}" for k in sums])


def source_targets(sizes: DataFrame, source_col: str, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``source_col, source_size, target`` from (source, source_size): weighted shares of the whole, at most
    ``max_epochs`` times a source; what is above is shared again by weight until none is above.

    The fixed point is found in one sweep: a source is held at its limit when the level (words for a unit
    of weight) that the other sources would get is above its own limit.
    """
    by_name = [F.col(source_col).asc_nulls_last()]
    s = _running(sizes.select(source_col, "source_size", F.lit(1).alias("one")), by_name, {"place": "one"}, "by_name")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    s = s.select(source_col, "source_size", w.cast("long").alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    by_limit = [(F.col("source_size") / F.col("w")).asc(), *by_name]
    s = _running(s, by_limit, {"cap_before": "cap", "w_before": "w"}, "by_limit")
    total, w_all = s.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(total or 0) - F.col("cap_before")).cast("double") / (F.lit(w_all or 0) - F.col("w_before"))
    s = s.withColumn("level", level).withColumn("held", F.col("w") * F.col("level") > F.col("cap"))
    final = s.where(~F.col("held")).agg(F.min(F.struct("cap_before", "level"))).first()[0]
    cap = F.col("cap").cast("double")
    target = F.when(F.col("held"), cap).otherwise(F.col("w") * F.lit(final.level if final else 0.0))
    return s.select(source_col, "source_size", F.least(target, cap).alias("target"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix-1",
    range_rows: int = 100_000,
) -> DataFrame:
    """Per row: ``id_col, source_col, size, source_size, target, taken``.

    ``taken`` is how many words of the document the mix takes, repeats counted: whole repeats of its source
    plus the part of its words below the cut, so that each source gives the floor of its target exactly.
    Sources are ordered by code point, null (a source of its own) last, and weigh ``weights`` in turn.
    Null and blank texts have size 0 and are taken 0 times. Rows with equal ids keep an order by size, rows without an id
    one by their text; equal rows share the cut in either order, with equal sums. An empty table gives an empty result.
    Text in other columns is never read. There are as many key ranges as keep one at about ``range_rows``
    rows whatever the size of the input (256 at least); their number does not change the result.
    """
    sized = materialize(_sized(df, id_col, text_col, source_col, seed), "sizes")
    placed = _placed(sized, weights, max_epochs, range_rows)
    return placed.select(F.col("__id").alias(id_col), F.col("__src").alias(source_col), "size", "source_size", "target", "taken")


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    own = F.coalesce(quoted(id_col).cast("string"), F.md5(quoted(text_col)), F.lit(""))  # rows without an id spread by their text
    key = F.md5(F.concat(F.lit(f"{seed}:"), own)).alias("__key")
    return df.select(quoted(id_col).alias("__id"), quoted(source_col).alias("__src"), word_count(quoted(text_col)).alias("size"), key, *more)


def _placed(sized: DataFrame, weights: tuple[int, ...], max_epochs: int, range_rows: int, *ties: str) -> DataFrame:
    """``sized`` with ``source_size, target, taken``; ``ties`` tell rows apart that are else equal."""
    ranges = min(2**24, max(256, -(-sized.count() // range_rows)))
    sized = sized.withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 6), 16, 10).cast("long") * ranges / 2**24))
    # grouped by (source, range) and then source: a hot source meets as `ranges` partial sums
    cuts = sized.groupBy("__src", "__range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    targets = source_targets(cuts.groupBy("__src").agg(F.sum("range_size").alias("source_size")), "__src", weights, max_epochs)
    cuts = cuts.alias("c").join(targets.alias("t"), F.col("c.__src").eqNullSafe(F.col("t.__src"))).select("c.*", "source_size", "target")
    inside = Window.partitionBy("__src", "__range").orderBy("__key", "__id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("s")
        .join(cuts.alias("c"), F.col("s.__src").eqNullSafe(F.col("c.__src")) & (F.col("s.__range") == F.col("c.__range")))
        .select("s.*", "c.offset", "c.source_size", "c.target")
    )
    budget = F.floor("target")
    epochs = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.withColumn("taken", taken.cast("long"))


def take_mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1", range_rows: int = 100_000
) -> DataFrame:
    """The documents of the mix with the columns of ``df``, whatever their names, once for each repeat.

    A document at the cut is kept whole: the cut is a budget in words, not an edit of the text. Documents without
    words are not taken. Rows that repeat an id, or have none, are taken each by its own part of the mix: rows are written
    once with numbers of their own, and only these numbers, with how often each is taken, are joined back.
    """
    number = F.monotonically_increasing_id().alias("__number")
    rows = materialize(_sized(df, id_col, text_col, source_col, seed, number, F.struct(*map(quoted, df.columns)).alias("__row")), "rows")
    chosen = _placed(rows.drop("__row"), weights, max_epochs, range_rows, "__number").where("taken > 0")
    chosen = chosen.select("__number", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    taken = rows.select("__number", "__row").join(chosen, "__number")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")
