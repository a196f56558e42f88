"""Aggregates over decisions and kept pairs. Each is one grouped aggregation; results are small tables.

Denominators differ on purpose: shares of kept pairs are null when nothing is kept, shares of all comparisons are 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepairs.config import RunConfig

CORRECTNESS_DRIVEN = ["correctness_priority_final_correctness", "strict_purified_final_correctness", "semi_purified_final_correctness", "answer_level_final_correctness"]
UTILITY_DRIVEN = ["current_utility", "correctness_priority_same_correctness_utility", "semi_purified_same_correctness_utility_screening"]
PURIFICATION_DROPS = [
    "dropped_both_correct_ambiguous", "dropped_both_wrong_uninformative", "dropped_weak_divergence", "dropped_trivial_segment_difference",
    "dropped_near_identical", "dropped_formatting_only", "dropped_unstable_boundary",
]


def kept() -> Column:
    return F.col("final_status").startswith("kept")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n``; null, empty and false count as 'unknown'."""
    value = F.when(F.col(column).cast("string").isin("", "false"), None).otherwise(F.col(column).cast("string"))
    return df.groupBy(F.coalesce(value, F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def orientation_counts(decided: DataFrame) -> DataFrame:
    return value_counts(decided.where(kept()), "orientation_reason")


QUALITY = {
    "weak_divergence": "weak_divergence",
    "formatting_only": "formatting_only_divergence",
    "near_identical": "near_identical_divergence",
    "trivial_difference": "trivial_difference_divergence",
    "boilerplate_only": "boilerplate_only_divergence",
    "unstable_boundary": "boundary_unstable",
    "degenerate_divergence": "degenerate_divergence",
}


def quality_counts(decided: DataFrame) -> DataFrame:
    """One row: how many comparisons have each flag."""
    return decided.agg(*[F.count_if(F.col(c)).alias(name) for name, c in QUALITY.items()])


#: Sections of the orientation audit: which comparisons belong to each (a comparison may belong to several).
SECTIONS = {
    "Kept, turned by the final answers": lambda: kept() & F.col("orientation_reason").isin(CORRECTNESS_DRIVEN),
    "Kept, turned by utility alone": lambda: kept() & F.col("orientation_reason").isin(UTILITY_DRIVEN),
    "Kept with equal final answers": lambda: F.col("final_status").isin(
        "kept_both_correct_strong_local_preference", "kept_both_wrong_delayed_error", "kept_same_correctness_utility_oriented"
    ),
    "Dropped for the divergence": lambda: F.col("final_status").isin([x for x in PURIFICATION_DROPS if not x.startswith("dropped_both")]),
    "Dropped for equal final answers": lambda: F.col("final_status").isin(
        "dropped_both_correct_ambiguous", "dropped_both_wrong_uninformative", "dropped_same_correctness_low_confidence"
    ),
    "Dropped for low confidence": lambda: F.col("final_status") == "dropped_low_confidence",
}


def in_sections(decided: DataFrame) -> DataFrame:
    """``decided`` with ``section``, once for each section of the orientation audit that a comparison belongs to."""
    mine = F.array_compact(F.array(*[F.when(rule(), F.lit(title)) for title, rule in SECTIONS.items()]))
    return decided.withColumn("section", F.explode(mine))


def _taxonomy() -> dict[str, Column]:
    pattern = F.col("correctness_pattern")
    out = {p: F.count_if(kept() & (pattern == p)) for p in ("correct_vs_incorrect", "incorrect_vs_correct", "both_correct", "both_wrong")}
    out["unresolved_or_skipped"] = F.count_if(~kept())
    out["same_prefix_but_weak_divergence"] = F.count_if(F.col("weak_divergence"))
    out["same_correctness_but_utility_oriented"] = F.count_if(kept() & F.col("orientation_reason").isin(UTILITY_DRIVEN) & pattern.isin("both_correct", "both_wrong"))
    return out


def taxonomy_counts(decided: DataFrame) -> DataFrame:
    return decided.agg(*[c.alias(name) for name, c in _taxonomy().items()])


def purity_report(decided: DataFrame, cfg: RunConfig) -> DataFrame:
    """One row: totals, taxonomy, shares of kept pairs by kind and orientation, boundary shares."""
    status, n, n_kept = F.col("final_status"), F.count(F.lit(1)), F.count_if(kept())
    of_kept = lambda c: F.try_divide(c.cast("double"), n_kept)
    of_all = lambda c: c.cast("double") / F.greatest(n, F.lit(1))
    t = _taxonomy()
    flag = lambda c: F.count_if(F.col(c))
    short = F.count_if(F.coalesce("divergent_min_chars", F.lit(0)) < cfg.pair.min_divergent_chars)
    return decided.agg(
        n.alias("num_trace_comparisons"),
        F.count_if(F.col("is_candidate") & ~F.col("is_capped")).alias("num_builder_candidates_before_method"),
        n_kept.alias("num_kept_pairs"),
        F.count_if(status == "dropped_low_confidence").alias("num_dropped_by_confidence"),
        *[c.alias(name) for name, c in t.items()],
        of_kept(t["correct_vs_incorrect"]).alias("fraction_strictly_instructional_pairs"),
        of_kept(t["both_correct"] + t["both_wrong"]).alias("fraction_ambiguous_pairs"),
        of_kept(t["incorrect_vs_correct"]).alias("fraction_misoriented_mixed_correctness_pairs"),
        of_all(F.count_if(status.isin(PURIFICATION_DROPS))).alias("fraction_dropped_by_purification"),
        of_kept(F.count_if(kept() & F.col("orientation_reason").isin(CORRECTNESS_DRIVEN))).alias("fraction_orientation_driven_by_correctness"),
        of_kept(F.count_if(kept() & F.col("orientation_reason").isin(UTILITY_DRIVEN))).alias("fraction_orientation_driven_only_by_utility"),
        *_boundary(of_all, flag, short if cfg.pair_type == "local_step" else F.count_if(F.lit(False))),
    )


def _boundary(of_all, flag, short: Column) -> list[Column]:
    return [
        of_all(flag("boundary_unstable")).alias("boundary_instability_rate"),
        of_all(flag("weak_divergence")).alias("weak_divergence_fraction"),
        of_all(flag("degenerate_divergence")).alias("degenerate_divergence_fraction"),
        of_all(flag("near_identical_divergence")).alias("near_identical_divergence_fraction"),
        of_all(short).alias("very_short_divergent_region_fraction"),
    ]


def average_steps(traces: DataFrame) -> DataFrame:
    return traces.agg(F.avg(F.size("steps")).alias("average_steps_per_trace"))


# --- confidence -------------------------------------------------------------------------------------------


def pair_confidence(df: DataFrame) -> Column:
    """Confidence, else that among the features, else the features' weight; null if none is there."""
    fields = df.schema["features"].dataType.fieldNames() if "features" in df.columns else []
    return F.coalesce(F.col("confidence"), *[F.col(f"features.{c}") for c in ("confidence", "weight") if c in fields])


def reliability_label() -> Column:
    """1 for a right preferred and wrong other branch, 0 for the reverse, else null."""
    pref, disp = F.col("pref_final_correct"), F.col("disp_final_correct")
    return F.when(pref != disp, (pref & ~disp).cast("int"))


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """``bin, lo, hi, n`` over [0, 1], the last bin closed; values outside count nowhere. Edges are literal."""
    edges = [float(x) for x in np.linspace(0.0, 1.0, bins + 1)]
    at = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        inside = (value >= edges[i]) & ((value <= edges[i + 1]) if i == bins - 1 else (value < edges[i + 1]))
        at = F.when(inside, F.lit(i)).otherwise(at)
    counts = df.select(at.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, lo double, hi double")
    return all_bins.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def median(df: DataFrame, value: Column, ranges: int = 1 << 20) -> DataFrame:
    """One row ``median``: exact, null without values; for values from 0 to 1.

    The values of each of many equal ranges are counted, which tells in which one or two of them the middle ranks are. Only
    the different values of those are then put in order, so no task holds those of all rows.
    """
    v = df.select(value.alias("v")).where("v is not null").select("v", F.least(F.floor(F.col("v") * ranges), F.lit(ranges - 1)).alias("at"))
    counts = v.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.orderBy("at"))
    counts = counts.select("at", (up_to - F.col("n")).alias("before"), up_to.alias("to"), F.sum("n").over(Window.partitionBy()).alias("all"))
    middle = [F.floor((F.col("all") + i) / 2) for i in (1, 2)]  # ranks from 1
    some = counts.where(((F.col("before") < middle[0]) & (middle[0] <= F.col("to"))) | ((F.col("before") < middle[1]) & (middle[1] <= F.col("to"))))
    inner = v.join(F.broadcast(some), "at").groupBy("v", "at", "before", "all").agg(F.count(F.lit(1)).alias("n"))
    place = F.col("before") + F.sum("n").over(Window.partitionBy("at").orderBy("v"))
    inner = inner.withColumn("to", place).withColumn("first", place - F.col("n"))
    one = lambda m: F.max(F.when((F.col("first") < m) & (m <= F.col("to")), F.col("v")))
    return inner.agg(((one(middle[0]) + one(middle[1])) / 2).alias("median"))


def _with_median(row: DataFrame, df: DataFrame, value: Column, name: str) -> DataFrame:
    """The one row ``row`` with the median in place of its column ``name``."""
    middle = median(df, value)  # one row each
    return row.drop(name).crossJoin(F.broadcast(middle)).select(*[F.col("median").alias(name) if c == name else F.col(c) for c in row.columns])


def confidence_stats(kept_pairs: DataFrame) -> DataFrame:
    c = pair_confidence(kept_pairs)
    row = kept_pairs.agg(F.count(F.lit(1)).alias("num_pairs"), F.avg(c).alias("mean_confidence"), F.lit(None).cast("double").alias("median_confidence"))
    return _with_median(row, kept_pairs, c, "median_confidence")


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate; null for fewer than two rows or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def branch_stats() -> list[Column]:
    pref, disp = F.col("pref_final_correct"), F.col("disp_final_correct")
    ok = pref.isNotNull() & disp.isNotNull()
    share = lambda c: F.avg(F.when(ok, c.cast("double")))
    return [
        F.count_if(ok).alias("eligible_pair_count"),
        share(pref != disp).alias("decisive_pair_fraction"),
        share(pref).alias("preferred_branch_final_correct_rate"),
        share(disp).alias("dispreferred_branch_final_correct_rate"),
        share(~pref & ~disp).alias("both_branches_incorrect_fraction"),
        share(pref & disp).alias("both_branches_correct_fraction"),
    ]


def with_process_hit(kept_pairs: DataFrame, gold: DataFrame | None) -> DataFrame:
    """``process_hit``: 1 if the pair diverges at its prompt's earliest wrong step, null without either."""
    if gold is None:
        return kept_pairs.withColumn("process_hit", F.lit(None).cast("int"))
    g = gold.select(F.col("id").alias("__id"), "gold_earliest_error_step")
    joined = kept_pairs.join(g, F.col("id") == F.col("__id"), "left").drop("__id")
    return joined.withColumn("process_hit", (F.col("k") == F.col("gold_earliest_error_step")).cast("int"))


def bucket_summary(kept_pairs: DataFrame, cfg: RunConfig, gold: DataFrame | None = None) -> DataFrame:
    """Always three rows: low, medium and high confidence."""
    c = pair_confidence(kept_pairs)
    t = cfg.confidence
    bucket = F.when(c < t.low_threshold, "low").when(c >= t.high_threshold, "high").otherwise("medium")
    rows = with_process_hit(kept_pairs, gold).withColumn("c", c)
    by = rows.where("c is not null").groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_confidence"), F.avg(reliability_label()).alias("preferred_branch_accuracy"),
        F.avg("process_hit").alias("process_boundary_accuracy"), *branch_stats(),
    )
    every = kept_pairs.agg(F.count(F.lit(1)).alias("num_pairs"))
    three = kept_pairs.sparkSession.createDataFrame([("low",), ("medium",), ("high",)], "bucket string")
    # `every` is one row
    out = three.join(by, "bucket", "left").crossJoin(F.broadcast(every))
    return out.select(
        "bucket",
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / F.greatest("num_pairs", F.lit(1))).alias("fraction"),
        "mean_confidence",
        "preferred_branch_accuracy",
        "process_boundary_accuracy",
        F.coalesce("eligible_pair_count", F.lit(0)).alias("eligible_pair_count"),
        *[c for c in by.columns if c.endswith(("_fraction", "_rate"))],
    )


def analysis(decided: DataFrame, cfg: RunConfig) -> DataFrame:
    """One row: the master report over kept pairs, with the share that the threshold dropped."""
    c = pair_confidence(decided)
    k, label = kept(), reliability_label()
    conf = F.when(k, c)
    decisive = F.when(k & c.isNotNull(), label)
    raw = F.count_if(F.col("is_candidate") & ~F.col("is_capped"))
    dropped = F.count_if(F.col("final_status") == "dropped_low_confidence")
    mean, right = F.avg(conf), F.avg(decisive)
    row = decided.agg(
        F.count_if(k).alias("num_pairs"),
        raw.alias("num_raw_pairs"),
        dropped.alias("num_dropped_by_confidence"),
        (dropped / F.greatest(raw, F.lit(1))).alias("fraction_dropped_by_threshold"),
        mean.alias("mean_confidence"),
        F.lit(None).cast("double").alias("median_confidence"),
        F.count(decisive).alias("decisive_pair_count"),
        right.alias("overall_decisive_pair_accuracy"),
        pearson(F.when(decisive.isNotNull(), conf), decisive).alias("confidence_correctness_correlation"),
        F.avg(F.when(c >= cfg.confidence.high_threshold, decisive)).alias("high_confidence_pair_accuracy"),
        (mean - right).alias("confidence_calibration_proxy"),
    )
    return _with_median(row, decided, conf, "median_confidence")
