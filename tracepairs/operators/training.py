"""What training reads and what it reports: batches of encoded pairs, and figures by optimizer step."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepairs.config import RunConfig
from tracepairs.operators.order import ranked, running_sums

SEQUENCES = ("prefix_ids", "pref_ids", "disp_ids")


# --- batches ------------------------------------------------------------------------------------------------


def epoch_order(seed: int, epoch: int, *keys: str) -> list[Column]:
    """A seeded order of the rows for one epoch, whatever their partitions; ``keys`` tell rows apart."""
    return [F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), *[F.col(k).cast("string") for k in keys])), *map(F.col, keys)]


def truncated(df: DataFrame, max_length: int) -> DataFrame:
    """Token ids cut to ``max_length``; null ones are empty."""
    return df.withColumns({c: F.slice(F.coalesce(c, F.array().cast("array<int>")), 1, max_length) for c in SEQUENCES})


def in_batches(df: DataFrame, order: list[Column], *, batch_size: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """``df`` with ``batch`` and ``place`` (both from 0): rows in ``order``, cut after every ``batch_size`` rows, or by the running
    sum of their tokens.

    With ``max_tokens`` a row belongs to the batch that the tokens before it are in: batches start at the first row at
    or after each multiple, so one holds up to ``max_tokens`` tokens and what its last row has beyond, and no batch is empty.
    """
    sizes = [x for x in (batch_size, max_tokens) if x is not None]
    if len(sizes) != 1 or sizes[0] < 1:
        raise ValueError("batches need a size of 1 or more, in rows or in tokens")
    if batch_size is not None:
        at = F.col("batch") - 1
        return ranked(df, order, "batch").withColumns({"batch": F.floor(at / batch_size), "place": (at % batch_size).cast("int")})
    tokens = sum((F.size(c) for c in SEQUENCES), F.lit(0))
    cut = running_sums(df, order, {"batch": tokens}).withColumn("batch", F.floor(F.col("batch") / max_tokens))
    # numbers without gaps: a long row can pass over a multiple
    used = ranked(cut.select("batch").distinct().withColumnRenamed("batch", "__cut"), [F.col("__cut")], "__batch")
    cut = cut.join(used, F.col("batch") == F.col("__cut")).withColumn("batch", F.col("__batch") - 1).drop("__cut", "__batch")
    return cut.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy(*order)) - 1)


def _padded(ids: Column, length: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), (length - F.size(ids)).cast("int")))


def collated(batched: DataFrame, pad_id: int, weight_col: str = "weight") -> DataFrame:
    """One row for each batch: arrays of its rows by place. Each kind of sequence is padded with ``pad_id`` to the longest of
    the batch; masks (1 for a token, 0 for padding) tell padding from a token that has its id. A batch has as many rows as
    it was cut to."""
    by = Window.partitionBy("batch")
    rows = batched.withColumns({f"__{c}": F.max(F.size(c)).over(by) for c in SEQUENCES})
    mask = lambda c: F.concat(F.array_repeat(F.lit(1), F.size(c)), F.array_repeat(F.lit(0), (F.col(f"__{c}") - F.size(c)).cast("int")))
    row = F.struct("place", *[_padded(F.col(c), F.col(f"__{c}"), pad_id).alias(c) for c in SEQUENCES], *[mask(c).alias(f"{c}_mask") for c in SEQUENCES], F.col(weight_col).cast("float").alias("weight"))
    whole = rows.groupBy("batch").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    names = [*SEQUENCES, *[f"{c}_mask" for c in SEQUENCES]]
    return whole.select("batch", *[F.col(f"rows.{c}").alias(c) for c in names], F.col("rows.weight").alias("weights"))


# --- figures by optimizer step --------------------------------------------------------------------------------


def learning_rate(step: Column, base: float, warmup: Column, total: Column) -> Column:
    """Rate of an optimizer step (from 1): rising evenly over the warm-up steps, then half a cosine down to 0."""
    done = step - 1
    share = (done - warmup) / F.greatest(F.lit(1), total - warmup)
    return base * F.when(done < warmup, done / F.greatest(F.lit(1), warmup)).otherwise(F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(math.pi * share))))


def optimizer_steps(metrics: DataFrame, cfg: RunConfig, *, run_col: str = "run", moving: int = 10) -> DataFrame:
    """Per run and optimizer step, from the metrics of its batches (``run_col, epoch, batch, loss, dpo_term, ref_pen``; epochs
    and batches count from 1).

    A step closes after ``grad_accum_steps`` batches, and at the end of an epoch with those that are left. It logs its last
    batch (``loss, dpo_term, ref_pen``), the mean loss of its batches, the mean of the logged losses of the last ``moving``
    steps, and its learning rate. Runs are partitions; the steps of one are as many as its training took.
    """
    t = cfg.training
    accumulation = t.grad_accum_steps
    epochs = metrics.groupBy(run_col).agg(F.max("batch").alias("__batches"))
    per_epoch = F.ceil(F.col("__batches") / accumulation)
    step = ((F.col("epoch") - 1) * per_epoch + F.ceil(F.col("batch") / accumulation)).cast("long")
    last = lambda c: F.max_by(F.coalesce(c, F.lit(0.0)), "batch").alias(c)
    steps = metrics.join(epochs, run_col).withColumn("step", step).groupBy(run_col, "step").agg(
        F.max("epoch").cast("int").alias("epoch"), F.count(F.lit(1)).alias("batches"), last("loss"), last("dpo_term"), last("ref_pen"), F.avg("loss").alias("mean_loss"), F.max(per_epoch).alias("__steps")
    )
    recent = Window.partitionBy(run_col).orderBy("step").rowsBetween(1 - moving, 0)
    total = (F.col("__steps") * t.num_epochs).cast("long")
    warmup = F.floor(total * t.warmup_ratio)
    out = steps.withColumns({"moving_loss": F.avg("loss").over(recent), "learning_rate": learning_rate(F.col("step"), t.lr, warmup, total)})
    return out.drop("__steps")


def training_summary(metrics: DataFrame, cfg: RunConfig, *, run_col: str = "run") -> DataFrame:
    """Per run: batches of an epoch, optimizer steps, effective batch size, and means over all batches. The penalty's mean
    is over the batches that have one, 0 without any."""
    t = cfg.training
    by_run = metrics.groupBy(run_col).agg(
        F.max("batch").cast("long").alias("num_batches"), F.countDistinct("epoch").alias("__epochs"), F.avg("loss").alias("mean_loss"),
        F.avg("dpo_term").alias("mean_dpo_term"), F.coalesce(F.avg("ref_pen"), F.lit(0.0)).alias("mean_ref_pen"),
    )
    steps = (F.ceil(F.col("num_batches") / t.grad_accum_steps) * F.col("__epochs")).cast("long")
    return by_run.select(
        run_col, "num_batches", steps.alias("num_steps"), F.lit(t.batch_size * t.grad_accum_steps).alias("effective_batch_size"), "mean_loss", "mean_dpo_term", "mean_ref_pen"
    )
