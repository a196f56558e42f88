"""Scoring of step prefixes, and the surfaces at which models plug in.

A scorer is a function of two columns (prompt, prefix) to a column, or of an iterator of pandas frames with these
columns to an iterator of score series, which Spark runs in Arrow batches with one model per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tracepairs.config import VerifierConfig
from tracepairs.functions import arrays as A
from tracepairs.functions import text as T
from tracepairs.functions.frames import relaxed

ColumnScorer = Callable[[Column, Column], Column]
BatchScorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.Series]]
_SCORERS: dict[str, ColumnScorer] = {}


def register_scorer(name: str, scorer: ColumnScorer) -> None:
    _SCORERS[name] = scorer


def scorer(name: str) -> ColumnScorer:
    if name not in _SCORERS:
        raise ValueError(f"unknown scorer {name!r}; registered: {', '.join(sorted(_SCORERS))}")
    return _SCORERS[name]


# --- verifiers: what a model reads and how its output becomes a score ---------------------------------------


def verifier_text(cfg: VerifierConfig, prompt: Column, prefix: Column) -> Column:
    """The text whose next token, token log probabilities or step rewards the configured verifier scores."""
    if cfg.mode == "judge_token":
        return T.judge_prompt(cfg.prompt_template, prompt, prefix)
    if cfg.mode == "mean_logprob":
        return T.log_prob_text(prompt, prefix)
    return T.reward_text(T.reward_turns(prompt, prefix, cfg.prm_system_prompt, cfg.prm_step_token))


def verifier_score(cfg: VerifierConfig, output: Column) -> Column:
    """The score in a model's output: of the logits (positive, negative) of the two judging tokens, of an array of token
    log probabilities, or of a struct (logits, token_mask) with labels' logits at each position."""
    if cfg.mode == "judge_token":
        return A.softmax_at(output, 0)
    if cfg.mode == "mean_logprob":
        return A.mean_log_prob(output)
    return A.process_reward(output["logits"], output["token_mask"], cfg.prm_positive_label_index)


def length_scorer(prompt: Column, prefix: Column) -> Column:
    """A deterministic stand-in for a model: shorter prefixes with more digits score higher, between 0 and 1."""
    digits = F.regexp_count(prefix, F.lit(r"\d"))
    return (1.0 + digits) / (2.0 + digits + F.length(prefix) / 100.0)


register_scorer("length", length_scorer)


def score_traces(traces: DataFrame, score: ColumnScorer) -> DataFrame:
    """``traces`` with ``step_scores`` (one for each prefix of the steps) and ``final_correct``; no shuffle."""
    scores = F.transform(T.cumulative_prefixes(F.col("steps")), lambda p: score(F.col("prompt"), p).cast("double"))
    return traces.withColumns({"step_scores": scores, "final_correct": T.is_correct_answer(F.col("final_answer"), F.col("answer"))})


def shared_steps(traces: DataFrame, keys: list[str] = ("prompt",)) -> DataFrame:
    """The prefix tree of each prompt: ``traces`` with ``shared``, the number of first steps whose prefix an earlier trace has.

    Traces of a prompt in the order of their steps are the leaves of its tree from left to right, and no trace shares more with
    an earlier one than with the one just before. So a trace adds the nodes below its first ``shared`` steps, and a prompt has
    as many different prefixes as its traces add.
    """
    before = F.lag("steps").over(Window.partitionBy(*keys).orderBy("steps"))
    rows = traces.withColumn("__before", before)
    same = F.coalesce(A.first_divergence(F.col("steps"), F.col("__before")), F.size("steps"))
    return rows.withColumn("shared", F.when(F.col("__before").isNull() | F.col("steps").isNull(), F.lit(0)).otherwise(same).cast("int")).drop("__before")


def prefix_counts(traces: DataFrame, keys: list[str] = ("prompt",)) -> DataFrame:
    """``keys, prefixes, different``: prefixes of all traces of a prompt, and how many of them differ (calls of a scorer)."""
    size = F.when(F.col("steps").isNull(), F.lit(0)).otherwise(F.size("steps"))
    return shared_steps(traces, keys).groupBy(*keys).agg(F.sum(size).cast("long").alias("prefixes"), F.sum(size - F.col("shared")).cast("long").alias("different"))


def _in_tree(score: BatchScorer, prompts: list[str], steps: list[list[str]], path: list, max_rows: int) -> list[list[float]]:
    """Scores of a run of traces in the order of their tree. ``path``: prompt, steps and scores of the trace before, replaced
    by those of the last one. Each node below what a trace shares with the one before is scored, at most ``max_rows`` at once."""
    prompt, own, known = path
    shared = []
    for p, s in zip(prompts, steps):
        m = 0
        while p == prompt and m < min(len(s), len(own)) and s[m] == own[m]:
            m += 1
        shared.append(m)
        prompt, own = p, s
    new = ((p, "\n".join(x for x in s[:i] if x is not None)) for p, s, m in zip(prompts, steps, shared) for i in range(m + 1, len(s) + 1))
    frames = (pd.DataFrame(rows, columns=["prompt", "prefix"]) for rows in iter(lambda: list(islice(new, max_rows)), []))
    fresh = iter([float(x) for values in score(frames) for x in values])
    out = []
    for s, m in zip(steps, shared):
        known = known[:m] + list(islice(fresh, len(s) - m))
        out.append(known)
    path[:] = [prompt, own, known]
    return out


def score_traces_in_batches(traces: DataFrame, make_scorer: Callable[[], BatchScorer], *, max_rows: int = 4096) -> DataFrame:
    """As :func:`score_traces` for a model, which ``make_scorer`` loads once for each task.

    Traces are put in ranges of (prompt, steps, trace), so that even a prompt with a large share of all traces is spread over
    tasks. A task walks along the prefix trees of its range: a prefix that the trace before has is not scored again but takes
    its score from there. So each different (prompt, prefix) is scored once, and the path at the border of two ranges twice.
    """
    rows = traces.drop("step_scores", "final_correct").withColumn("__steps", F.coalesce("steps", F.array().cast("array<string>")))
    rows = rows.select(*[F.col(f"`{f.name}`").cast(relaxed(f.dataType)).alias(f.name) for f in rows.schema])
    path_order = ["prompt", "__steps", "trace_id"]
    rows = rows.repartitionByRange(*path_order).sortWithinPartitions(*path_order)
    schema = StructType([*rows.drop("__steps").schema, StructField("step_scores", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, path = make_scorer(), [None, [], []]
        for b in batches:
            at = {name: b.schema.get_field_index(name) for name in ("prompt", "__steps")}
            scores = _in_tree(score, b.column(at["prompt"]).to_pylist(), b.column(at["__steps"]).to_pylist(), path, max_rows)
            kept = [i for i in range(b.num_columns) if i != at["__steps"]]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(scores, pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("final_correct", T.is_correct_answer(F.col("final_answer"), F.col("answer")))


def parse_generations(generated: DataFrame) -> DataFrame:
    """Trace records from (id, prompt, answer, trace_id, reasoning): steps and final answer."""
    steps, final = T.split_steps(F.col("reasoning")), T.extract_final_answer(F.col("reasoning"))
    return generated.withColumns({"steps": steps, "final_answer": F.coalesce(final, F.lit(""))})


def generate_traces(prompts: DataFrame, num_traces: int, make_generator: Callable[[], Callable[[list[str], int], list[list[str]]]]) -> DataFrame:
    """``num_traces`` trace records per prompt. ``make_generator`` runs once per task and gives a function from a batch
    of prompts to ``num_traces`` texts each."""
    kinds = {f.name: f.dataType.simpleString() for f in prompts.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generator()
        for pdf in batches:
            texts = generate(pdf["prompt"].tolist(), num_traces)
            rows = [(i, p, a, t, text) for (i, p, a), own in zip(pdf[["id", "prompt", "answer"]].itertuples(index=False), texts) for t, text in enumerate(own)]
            yield pd.DataFrame(rows, columns=["id", "prompt", "answer", "trace_id", "reasoning"])

    out = prompts.select("id", "prompt", "answer").mapInPandas(run, f"id {kinds['id']}, prompt string, answer string, trace_id int, reasoning string")
    return parse_generations(out)


def grade(predictions: DataFrame) -> DataFrame:
    """``predictions`` (output text, gold answer) with the answer found and whether it is right."""
    found = F.coalesce(T.extract_final_answer(F.col("output")), F.lit(""))
    return predictions.withColumn("pred", found).withColumn("correct", T.is_correct_answer(F.col("pred"), F.col("answer")))


def final_accuracy(graded: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return graded.agg(n.alias("num_examples"), F.count_if(F.col("correct")).alias("num_correct"), (F.count_if(F.col("correct")) / F.greatest(n, F.lit(1))).alias("final_accuracy"))
