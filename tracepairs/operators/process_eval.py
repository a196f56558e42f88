"""Where the earliest wrong step is: predictions from pairs against gold positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_gold(gold: DataFrame) -> DataFrame:
    """Two traces for each gold row: the right one (trace 0) and the wrong one (trace 1). Fails on incomplete rows."""
    need = ["prompt", "answer", "correct_steps", "incorrect_steps"]
    ok = F.lit(True)
    for c in need:
        ok = ok & F.col(c).isNotNull()
    ok = ok & (F.col("prompt") != "") & (F.size("correct_steps") > 0) & (F.size("incorrect_steps") > 0)
    fail = F.raise_error(F.lit("gold rows need prompt, answer, correct_steps and incorrect_steps")).cast("string")
    one = lambda i, steps, final: F.struct(F.lit(i).alias("trace_id"), F.col(steps).alias("steps"), F.array_join(steps, "\n").alias("reasoning"), final.alias("final_answer"))
    both = F.array(one(0, "correct_steps", F.col("answer")), one(1, "incorrect_steps", F.coalesce("incorrect_final_answer", F.lit(""))))
    return gold.select(F.when(ok, F.col("id")).otherwise(fail).alias("id"), "prompt", "answer", F.explode(both).alias("t")).select("id", "prompt", "answer", "t.*")


def predict(kept_pairs: DataFrame) -> DataFrame:
    """``id, pred, score, num_candidates``: the position of the pair with the highest score, the first of equals."""
    score = F.coalesce("confidence", "training_weight")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "a_ord", "b_ord")
    rows = kept_pairs.where("k is not null").select("id", "k", score.alias("score"), "a_ord", "b_ord")
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("num_candidates"))
    best = rows.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return best.join(counts, "id").select("id", F.col("k").alias("pred"), "score", "num_candidates")


def judge(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per gold row, predicted or not."""
    size = lambda c: F.when(F.size(c) > 0, F.size(c)) if c in gold.columns else F.lit(None).cast("int")
    g = gold.select("id", F.col("gold_earliest_error_step").alias("gold"), size("correct_steps").alias("step_count_correct"), size("incorrect_steps").alias("step_count_incorrect"))
    hit = F.col("pred").eqNullSafe(F.col("gold"))
    near = F.coalesce(F.abs(F.col("pred") - F.col("gold")) <= 1, F.lit(False))
    return g.join(predictions, "id", "left").select(
        "id", "gold", "pred", hit.alias("correct"), near.alias("near_miss"), F.col("score").alias("prediction_score"),
        F.coalesce("num_candidates", F.lit(0)).alias("num_candidates"), "step_count_correct", "step_count_incorrect",
    )


def metrics(judged: DataFrame) -> DataFrame:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return judged.agg(
        (F.count_if(F.col("correct")) / n).alias("earliest_error_exact"),
        (F.count_if(F.col("near_miss")) / n).alias("earliest_error_near_miss"),
        (F.count("pred") / n).alias("coverage"),
        F.count(F.lit(1)).alias("num_evaluated_examples"),
        F.count_if(F.col("correct")).alias("num_correct"),
        F.count_if(~F.col("correct")).alias("num_incorrect"),
    )


def confusion(judged: DataFrame) -> DataFrame:
    """Counts by gold and predicted position, null for no prediction."""
    return judged.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def failures(judged: DataFrame, most: int = 15) -> DataFrame:
    """The first ``most`` wrong rows by id (a top-k report)."""
    return judged.where(~F.col("correct")).orderBy("id").limit(most)
