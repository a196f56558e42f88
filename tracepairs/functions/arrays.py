"""Functions over arrays of steps and scores, as Column expressions. Positions count from 0; ``k`` is a position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SEGMENT_SCORE = -1e9
SCORE_EPSILON = 1e-6


def first_divergence(canon_a: Column, canon_b: Column) -> Column:
    """First position where the canonical steps differ, a missing step included; null if there is none."""
    same = F.zip_with(canon_a, canon_b, lambda x, y: x.eqNullSafe(y))
    return F.nullif(F.array_position(same, False), F.lit(0)).cast("int") - 1


def segment(values: Column, k: Column, h: int) -> Column:
    """Up to ``h`` values from position ``k``."""
    return F.slice(values, k + 1, F.lit(h))


def prefix(values: Column, k: Column) -> Column:
    return F.slice(values, F.lit(1), k)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def z_scores(scores: Column, mean: Column, std: Column) -> Column:
    return F.transform(scores, lambda x: (x - F.coalesce(mean, F.lit(0.0))) / (F.coalesce(std, F.lit(0.0)) + SCORE_EPSILON))


def local_score(z: Column, k: Column, h: int) -> Column:
    """Mean of the segment's scores; a very low value without scores."""
    seg = segment(z, k, h)
    return F.when(F.size(seg) > 0, total(seg) / F.size(seg)).when(k.isNotNull(), F.lit(NO_SEGMENT_SCORE))


def drop_at(z: Column, k: Column) -> Column:
    """How far the score falls at ``k``, 0 at the ends."""
    return F.when((k <= 0) | (k >= F.size(z)), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.get(z, k - 1) - F.get(z, k)))


def utility(local: Column, correct: Column, alpha: float) -> Column:
    return alpha * local + (1.0 - alpha) * correct.cast("double")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def reconverges(canon_a: Column, canon_b: Column, k: Column, h: int) -> Column:
    """Whether the steps after ``k`` within the window are there and equal."""
    if h < 2:
        return F.lit(False)
    a, b = F.slice(canon_a, k + 2, F.lit(h - 1)), F.slice(canon_b, k + 2, F.lit(h - 1))
    return (F.size(a) > 0) & (a == b)


def mean_score(scores: Column) -> Column:
    return total(scores) / F.greatest(F.size(scores), F.lit(1))


def softmax_at(logits: Column, label: int) -> Column:
    """Weight of position ``label``."""
    top = F.array_max(logits)
    return F.exp(F.get(logits, F.lit(label)) - top) / total(F.transform(logits, lambda x: F.exp(x - top)))


def process_reward(logits: Column, token_mask: Column, positive_label: int = 1) -> Column:
    """Softmax weight of the positive label at the last position that ``token_mask`` marks; 0 without one.

    ``logits``: array (positions) of arrays (labels).
    """
    marked = F.filter(F.arrays_zip(logits.alias("l"), token_mask.alias("m")), lambda x: x["m"] != 0)
    last = F.try_element_at(marked, F.lit(-1))
    return F.when(F.size(marked) > 0, softmax_at(last["l"], positive_label)).otherwise(F.lit(0.0))


def mean_log_prob(token_log_probs: Column) -> Column:
    return F.when(F.size(token_log_probs) >= 1, total(token_log_probs) / F.size(token_log_probs)).otherwise(F.lit(0.0))


def reference_penalty(own_pref: Column, ref_pref: Column, own_disp: Column, ref_disp: Column) -> Column:
    """Mean squared distance of token log probabilities from the reference's, averaged over both branches."""

    def gap(a: Column, b: Column) -> Column:
        sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
        return total(sq) / F.greatest(F.size(sq), F.lit(1))

    return 0.5 * (gap(own_pref, ref_pref) + gap(own_disp, ref_disp))


def dpo_loss_terms(lp_pref: Column, lp_disp: Column, ref_pref: Column, ref_disp: Column, weight: Column, beta: float, *, penalty: Column | None = None, lambda_ref: float = 0.0) -> Column:
    """Struct (delta, dpo_term, loss) of a weighted preference pair from its sequence log probabilities.

    With ``lambda_ref`` above 0 the less a pair weighs, the more its ``penalty`` (:func:`reference_penalty`) counts.
    """
    delta = (lp_pref - lp_disp) - (ref_pref - ref_disp)
    x = beta * delta
    term = F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))  # -log sigmoid without overflow
    loss = weight * term
    if lambda_ref > 0:
        loss = loss + lambda_ref * (1.0 - weight) * penalty
    return F.struct(delta.alias("delta"), term.alias("dpo_term"), loss.alias("loss"))


def token_loss_terms(own_pref: Column, own_disp: Column, ref_pref: Column, ref_disp: Column, weight: Column, *, beta: float, lambda_ref: float) -> Column:
    """As :func:`dpo_loss_terms` from arrays of token log probabilities, whose sums are those of the sequences."""
    penalty = reference_penalty(own_pref, ref_pref, own_disp, ref_disp)
    return dpo_loss_terms(total(own_pref), total(own_disp), total(ref_pref), total(ref_disp), weight, beta, penalty=penalty, lambda_ref=lambda_ref)


def schedule_steps(batches: int, accumulation: int, epochs: int, warmup_ratio: float) -> tuple[int, int]:
    """Optimizer steps and warm-up steps."""
    steps = -(-batches // accumulation) * epochs
    return steps, int(steps * warmup_ratio)
