"""Seeded samples and data preparation.

Samples repeat Python's seeded generator, so the chosen ordinals are drawn on the driver (as many numbers as
rows are wanted, never the rows) and joined to the data.
"""

from __future__ import annotations

import random
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracepairs.config import RunConfig
from tracepairs.functions import text as T
from tracepairs.operators.order import ranked
from tracepairs.operators.process_rows import process_rows_of
from tracepairs.sources.jsonl import read_jsonl, write_jsonl

_BROADCAST_ORDINALS = 500_000


def sample_ordinals(n: int, limit: int | None, seed: int) -> list[int] | None:
    """Ordinals to keep, rising; None for all."""
    if limit is None or limit >= n:
        return None
    return sorted(random.Random(seed).sample(range(n), limit))


def sample_rows(df: DataFrame, limit: int | None, seed: int, ord_col: str = "ord") -> DataFrame:
    """``limit`` rows of ``df`` whose ordinals (0 to n - 1) a seeded draw without replacement chooses."""
    chosen = sample_ordinals(df.count(), limit, seed)
    if chosen is None:
        return df
    keep = df.sparkSession.createDataFrame([(i,) for i in chosen], f"{ord_col} long")
    return df.join(F.broadcast(keep) if len(chosen) <= _BROADCAST_ORDINALS else keep, ord_col, "left_semi")


# --- prompts of a run ------------------------------------------------------------------------------------


def with_line_ordinals(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """``df``, read from files, with ordinals from 0 in the order of file names and of lines.

    The rows of each split of a file are counted first; splits, not rows, are put in order, and their table is broadcast only
    if Spark finds it small. Splits of a task follow each other, so a row's place in its split is told by its place in the task.
    """
    split = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    rows = df.withColumn("__split", split).withColumn("__row", F.monotonically_increasing_id())
    splits = rows.groupBy("__split").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("first"))
    before = F.sum("n").over(Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    shifts = splits.select("__split", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__shift"))
    placed = rows.join(shifts, "__split")
    return placed.withColumn(ord_col, F.col("__row") + F.col("__shift")).drop("__split", "__row", "__shift")


def load_prompts(spark: SparkSession, cfg: RunConfig, which: str = "train") -> DataFrame:
    """The prompts to train on (``train``) or to evaluate on (``eval``), in the number that the configuration allows.

    Evaluation prompts come from their own file, or the training file if there is none, and are drawn with the next seed.
    """
    evaluate = {"train": False, "eval": True}[which]
    path = (cfg.paths.eval_prompt_file if evaluate else None) or cfg.paths.prompt_file
    limit = cfg.data.max_eval_prompts if evaluate else cfg.data.max_train_prompts
    rows = read_jsonl(spark, path, "prompt")
    return rows if limit is None else sample_rows(with_line_ordinals(rows), limit, cfg.data.prompt_sampling_seed + evaluate).drop("ord")


def prepare_data(spark: SparkSession, cfg: RunConfig, train: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """Writes the prompt, evaluation and process files of a configuration, as far as it names them, from (ord, question,
    answer) rows. Their seeds follow each other."""
    d, p = cfg.data, cfg.paths
    if d.max_train_prompts is None or d.max_eval_prompts is None:
        raise ValueError("data preparation needs max_train_prompts and max_eval_prompts")
    prompts = lambda df, split, n, seed: gsm8k_prompts(df, split, n, seed, append_suffix=d.append_step_by_step_suffix)
    made = {p.prompt_file: prompts(train, "train", d.max_train_prompts, d.prompt_sampling_seed)}
    if p.eval_prompt_file:
        made[p.eval_prompt_file] = prompts(test, "test", d.max_eval_prompts, d.prompt_sampling_seed + 1)
    if p.process_ground_truth_file and d.max_process_examples:
        made[p.process_ground_truth_file] = process_rows(spark, d.max_process_examples, d.prompt_sampling_seed + 2)
    for path, df in made.items():
        write_jsonl(df, path)
    return made


def gsm8k_prompts(df: DataFrame, split: str, count: int, seed: int, *, append_suffix: bool = True, ord_col: str = "ord") -> DataFrame:
    """Prompt records of a sample of (ord, question, answer) rows, numbered in source order."""
    total = df.count()
    order = sorted(random.Random(seed).sample(range(total), min(count, total)))
    place = df.sparkSession.createDataFrame([(o, i) for i, o in enumerate(order)], f"{ord_col} long, out int")
    rows = df.join(F.broadcast(place) if len(order) <= _BROADCAST_ORDINALS else place, ord_col)
    parsed = T.gsm8k_answer(F.col("answer"))
    return rows.select(
        F.format_string("%s_%05d", F.translate(F.lit(split), "[]:", "___"), F.col("out")).alias("id"),
        T.prompt_with_suffix(F.col("question"), append_suffix).alias("prompt"),
        parsed["answer"].alias("answer"),
        parsed["solution"].alias("reference_solution"),
        F.lit(split).alias("source_split"),
    )


def process_rows(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """``count`` gold records, numbered from 0; see :func:`process_rows_of`."""
    return process_rows_of(spark.range(count), F.col("id").cast("string"), F.format_string("process_%05d", "id"), seed)


# --- audits ------------------------------------------------------------------------------------------------

_BLOCK = 1 << 20  # draws of a shuffle that are held at once


def shuffled_ordinals(rng: random.Random, n: int, k: int) -> list[int]:
    """The first ``k`` of the ordinals 0 to n - 1 after ``rng.shuffle``, without a list of ``n``.

    The shuffle swaps position i, from n - 1 down to 1, with a drawn one. Followed backwards from i = 1 up, only ``k`` positions
    matter: a table keeps where each of them came from. Draws are needed in the opposite order of the generator's, so its
    state is noted every ``_BLOCK`` draws and each block drawn again. The generator is left as the shuffle leaves it.
    """
    starts, states = list(range(n - 1, 0, -_BLOCK)), []
    for start in starts:
        states.append(rng.getstate())
        for i in range(start, max(start - _BLOCK, 0), -1):
            rng.randrange(i + 1)
    after = rng.getstate()
    at = {p: p for p in range(min(k, n))}  # where it stands now: its final place
    for start, state in zip(reversed(starts), reversed(states)):
        rng.setstate(state)
        draws = [(i, rng.randrange(i + 1)) for i in range(start, max(start - _BLOCK, 0), -1)]
        for i, j in reversed(draws):
            if i != j and (i in at or j in at):
                x, y = at.pop(i, None), at.pop(j, None)
                at.update({p: v for p, v in ((j, x), (i, y)) if v is not None})
    rng.setstate(after)
    return [p for p, _ in sorted(at.items(), key=lambda x: x[1])]


def audit_sample(df: DataFrame, bucket_col: str, buckets: list[str], order: list[Column], per_bucket: int, seed: int) -> DataFrame:
    """Up to ``per_bucket`` rows of each bucket, with ``place`` (from 0): the first ones after one seeded generator has
    shuffled the rows of each bucket in turn, which stand in ``order`` before that.

    Rows are numbered within their buckets in ranges (:func:`ranked`); only the buckets' sizes reach the driver, which follows
    the shuffle by numbers, and the drawn numbers are joined back.
    """
    rows = ranked(df.where(F.col(bucket_col).isin(buckets)), order, "__ordinal", [bucket_col])
    sizes = {r[0]: r[1] for r in rows.groupBy(bucket_col).agg(F.max("__ordinal")).collect()}
    rng = random.Random(seed)
    drawn = [(b, o + 1, place) for b in buckets for place, o in enumerate(shuffled_ordinals(rng, sizes.get(b, 0), per_bucket))]
    chosen = df.sparkSession.createDataFrame(drawn, f"`{bucket_col}` string, __ordinal long, place int")
    few = len(drawn) <= _BROADCAST_ORDINALS
    return rows.join(F.broadcast(chosen) if few else chosen, [bucket_col, "__ordinal"]).select(*df.columns, "place")
