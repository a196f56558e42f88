"""Preference pairs from scored traces: one row per comparison of two traces of a prompt, kept or not, with a reason.

``decisions`` is one lazy plan: traces are exchanged by prompt; canonical steps, group statistics, step support and the
forms of segments are computed once per trace, and exchanged once more, so that both sides of the self-join read the same
rows. A comparison looks these up, and computes only what depends on both traces: where they diverge, and its flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracepairs.config import ClassGate, RunConfig
from tracepairs.functions import arrays as A
from tracepairs.functions import text as T
from tracepairs.functions.similarity import histogram, near_identical, signature_similarity
from tracepairs.operators.order import ranked

KEPT = "kept"
CANDIDATE = ("kept_mixed_correctness", "kept_same_correctness_utility_oriented", "kept_both_correct_strong_local_preference", "kept_both_wrong_delayed_error")


# --- per trace -------------------------------------------------------------------------------------------


def with_places(traces: DataFrame) -> DataFrame:
    """``traces``, exchanged by prompt, with ``ord``, a trace's place among those of its prompt, and ``prompt_ord``, its prompt's.

    Where traces have ``ord`` (their line in the file, see :func:`tracepairs.operators.sampling.with_line_ordinals`), it
    is kept, and prompts follow each other as they are first seen. Else the traces of a prompt are ordered by trace_id, repeated
    ones by their steps and scores, and all prompts have place 0.
    """
    t = traces.repartition("id")
    if "ord" in traces.columns:
        return t.withColumns({"ord": F.col("ord").cast("long"), "prompt_ord": F.min(F.col("ord").cast("long")).over(Window.partitionBy("id"))})
    order = Window.partitionBy("id").orderBy("trace_id", "steps", "step_scores")
    return t.withColumns({"ord": F.row_number().over(order).cast("long"), "prompt_ord": F.lit(0).cast("long")})


def prepare(traces: DataFrame) -> DataFrame:
    """``id, prompt_ord, ord, trace_id, steps, canon, z, support, reach, final_correct``, exchanged by prompt.

    ``z``: scores normalised over all step scores of the prompt (population deviation). ``support``: for each step
    how many of the prompt's traces have the same canonical step at this position, and their share correct.
    ``reach``: a position; from later ones no other trace of the prompt diverges that has a step there too.
    Traces are told apart by their places (:func:`with_places`), so a trace_id may occur again in a prompt: each such trace
    counts, and all take the scores of the last one.
    """
    last = F.last("step_scores").over(Window.partitionBy("id", "trace_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = with_places(traces.withColumn("canon", T.canon_steps(F.col("steps")))).withColumn("last_scores", last)
    t = t.select("id", "prompt_ord", "ord", "trace_id", "steps", "canon", "step_scores", "last_scores", "final_correct")
    long = t.select("id", "ord", "final_correct", "canon", F.posexplode_outer(F.arrays_zip("canon", "step_scores")).alias("pos", "s"))
    # equal prefixes have equal numbers; where others do too, some forms more are computed than looked up
    long = long.withColumn("before", F.xxhash64(F.slice("canon", F.lit(1), F.col("pos")))).drop("canon")
    by_prompt, by_step, by_prefix = Window.partitionBy("id"), Window.partitionBy("id", "pos", "s.canon"), Window.partitionBy("id", "pos", "before")
    long = (
        long.withColumn("n", F.count(F.lit(1)).over(by_step))
        .withColumn("p", F.avg(F.col("final_correct").cast("double")).over(by_step))
        .withColumn("mean", F.avg("s.step_scores").over(by_prompt))
        .withColumn("std", F.stddev_pop("s.step_scores").over(by_prompt))
        .withColumn("shared", F.count(F.lit(1)).over(by_prefix))
    )
    one = F.when(F.col("pos").isNotNull(), F.struct("pos", "n", "p"))
    stats = long.groupBy("id", "ord").agg(F.sort_array(F.collect_list(one)).alias("support"), F.first("mean").alias("mean"), F.first("std").alias("std"), F.max(F.when(F.col("shared") > 1, F.col("pos"))).alias("reach"))
    z = A.z_scores(F.col("last_scores"), F.col("mean"), F.col("std")).alias("z")
    return t.join(stats, ["id", "ord"]).select("id", "prompt_ord", "ord", "trace_id", "steps", "canon", z, "support", "reach", "final_correct")


def segment_forms(steps: Column, canon: Column, reach: Column, cfg: RunConfig) -> Column:
    """For each position up to ``reach`` the forms of the segment there that flags compare: ``sig``, its letters counted (where
    a similarity is asked for), and from the canonical form of its text ``alnum``, ``words``, ``math`` and ``preamble``."""
    h, counted = cfg.pair.window_H, cfg.pair.max_near_identical_similarity <= 1

    def form(p: Column) -> Column:
        # a blank step has a blank canonical form, which leaves nothing in the signature
        sig = T.let(T.signature_of_canon(A.segment(canon, p, h)), lambda s: F.struct(s.alias("sig"), *([histogram(s).alias("letters")] if counted else [])))
        own = T.let(
            T.canon(T.segment_text(A.segment(steps, p, h))),
            lambda c: F.struct(T.alnum_of_canon(c).alias("alnum"), F.array_join(T.tokens_of_canon(c), " ").alias("words"), T.math_of_canon(c).alias("math"), T.preamble_of_canon(c).alias("preamble")),
        )
        return F.struct(sig.alias("s"), own.alias("c"))

    last = F.least(reach, F.size(steps) - 1)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), form))


def comparisons(prepared: DataFrame) -> DataFrame:
    """Structs ``a`` and ``b`` for each two traces of a prompt, a before b, and ``k``, where they diverge.

    Both sides use the same columns, so that Spark finds their exchange to be the same one.
    """
    rows = prepared.repartition("id")
    one = F.struct(*[c for c in rows.columns if c != "id"])
    pairs = rows.select("id", one.alias("a")).join(rows.select("id", one.alias("b")), "id").where(F.col("a.ord") < F.col("b.ord"))
    return pairs.withColumns({"prompt_ord": F.least("a.prompt_ord", "b.prompt_ord"), "k": A.first_divergence(F.col("a.canon"), F.col("b.canon"))})


def compared(traces: DataFrame, cfg: RunConfig) -> DataFrame:
    """The comparisons with the flags of their segments."""
    prepared = prepare(traces)
    forms = segment_forms(F.col("steps"), F.col("canon"), F.col("reach"), cfg)
    return _divergence(comparisons(prepared.withColumn("forms", forms).drop("reach")), cfg)


# --- divergence and orientation ------------------------------------------------------------------------


def _divergence(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """Flags of the two segments at ``k``; null where a segment is missing or empty."""
    p, h, k = cfg.pair, cfg.pair.window_H, F.col("k")
    df = df.withColumns({f"seg_{x}": A.segment(F.col(f"{x}.steps"), k, h) for x in "ab"})
    there = k.isNotNull() & (F.size("seg_a") > 0) & (F.size("seg_b") > 0)
    df = df.withColumns({"there": there, **{f"form_{x}": F.get(F.col(f"{x}.forms"), k) for x in "ab"}})
    sig_a, sig_b, own_a, own_b = (F.col(f"form_{x}.{part}") for part in ("s.sig", "c") for x in "ab")
    if p.max_near_identical_similarity > 1:  # no similarity can reach it: nothing to compute
        df = df.withColumns({"similarity": F.lit(None).cast("double"), "near_identical": F.lit(False)})
    else:
        # the flag matches only what its bounds leave open; the value itself is computed only where a plan selects it
        own = {x: F.when(F.col("there"), sig) for x, sig in (("a", sig_a), ("b", sig_b))}
        letters = (F.col("form_a.s.letters"), F.col("form_b.s.letters"))
        df = df.withColumns({"similarity": signature_similarity(own["a"], own["b"]), "near_identical": near_identical(own["a"], own["b"], p.max_near_identical_similarity, letters)})
    df = df.withColumns({"math": own_a["math"] | own_b["math"], "min_chars": F.least(F.length(sig_a), F.length(sig_b))})
    math = F.col("math")
    df = df.withColumns({
        "too_short": F.col("min_chars") < p.min_divergent_chars,
        "exact_match": sig_a == sig_b,
        "reconverges": A.reconverges(F.col("a.canon"), F.col("b.canon"), k, h),
        "formatting_only": own_a["alnum"] == own_b["alnum"],
        "boilerplate_only": own_a["preamble"] & own_b["preamble"] & ~math,
    })
    df = df.withColumn("trivial_difference", F.col("too_short") | ((own_a["words"] == own_b["words"]) & ~math))
    weak = ["too_short", "exact_match", "formatting_only", "near_identical", "reconverges", "trivial_difference", "boilerplate_only"]
    return df.withColumn("weak", F.greatest(*[F.col(c) for c in weak]))


def _infos(df: DataFrame, cfg: RunConfig) -> DataFrame:
    k, p = F.col("k"), cfg.pair
    for x in "ab":
        z = F.col(f"{x}.z")
        local = A.local_score(z, k, p.window_H)
        support = F.get(F.col(f"{x}.support"), k)
        info = F.struct(
            local.alias("local"),
            A.drop_at(z, k).alias("drop"),
            A.utility(local, F.col(f"{x}.final_correct"), p.alpha_local).alias("utility"),
            support["n"].alias("n"),
            support["p"].alias("p"),
            F.col(f"{x}.trace_id").alias("trace_id"),
            F.col(f"{x}.final_correct").alias("correct"),
        )
        df = df.withColumn(f"i{x}", info)
    margin = F.abs(F.col("ia.utility") - F.col("ib.utility"))
    return df.withColumns({"utility_margin": F.when(F.col("there"), margin), "local_gap": F.when(F.col("there"), F.abs(F.col("ia.local") - F.col("ib.local")))})


def _orientation(cfg: RunConfig) -> tuple[Column, Column, Column]:
    """Drop reason (null: oriented), orientation reason, and whether a is preferred."""
    mode, a_right, mixed = cfg.pair.pair_mode, F.col("ia.correct"), F.col("ia.correct") != F.col("ib.correct")
    close = F.when(F.col("utility_margin") < cfg.pair.tau_pair, F.lit("dropped_utility_margin_below_tau_pair"))
    higher = F.col("ia.utility") >= F.col("ib.utility")
    if mode == "current_utility":
        return close, F.lit("current_utility"), higher
    weak = (
        F.when(F.col("formatting_only"), "dropped_formatting_only")
        .when(F.col("near_identical"), "dropped_near_identical")
        .when(F.col("reconverges"), "dropped_unstable_boundary")
        .when(F.col("trivial_difference") | F.col("boilerplate_only"), "dropped_trivial_segment_difference")
        .when(F.col("weak"), "dropped_weak_divergence")
    )
    if mode == "strict_purified":
        same = F.when(~mixed, F.when(a_right, F.lit("dropped_both_correct_ambiguous")).otherwise(F.lit("dropped_both_wrong_uninformative")))
        return F.coalesce(weak, same), F.lit("strict_purified_final_correctness"), a_right
    by_utility = {"correctness_priority": "correctness_priority_same_correctness_utility", "semi_purified": "semi_purified_same_correctness_utility_screening"}[mode]
    drop = F.when(~mixed, close)
    drop = F.coalesce(weak, drop) if mode == "semi_purified" else drop
    return drop, F.when(mixed, F.lit(f"{mode}_final_correctness")).otherwise(F.lit(by_utility)), F.when(mixed, a_right).otherwise(higher)


def confidence_features(margin: Column, pref_drop: Column, disp_drop: Column, pref_n: Column, disp_n: Column, pref_p: Column, disp_p: Column, cfg: RunConfig) -> Column:
    """Struct of the four features and their weighted mean ``confidence``, each from 0 to 1."""
    c = cfg.confidence
    features = {
        "f_margin": (c.use_margin, c.gamma_margin, A.sigmoid((margin - c.tau_margin) / c.scale_margin)),
        "f_sharp": (c.use_sharp, c.gamma_sharp, A.sigmoid((disp_drop - pref_drop) / c.scale_drop)),
        "f_agree": (c.use_agree, c.gamma_agree, pref_n / (pref_n + disp_n + 1e-6)),
        "f_out": (c.use_out, c.gamma_out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1.0 + (pref_p - disp_p)) / 2.0))),
    }
    used = [(gamma, value) for use, gamma, value in features.values() if use]
    whole = sum(gamma for gamma, _ in used) or 1.0
    mean = sum((gamma * value for gamma, value in used), F.lit(0.0)) / whole
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean))
    return F.struct(*[value.alias(name) for name, (_, _, value) in features.items()], confidence.alias("confidence"))


def _passes(gate: ClassGate) -> Column:
    ok = (F.col("utility_margin") >= gate.min_utility_margin) & (F.col("local_gap") >= gate.min_local_gap) & (F.col("confidence") >= gate.min_confidence) & (F.col("support_gap") >= gate.min_support_gap)
    return ok if gate.min_drop_advantage is None else ok & (F.col("drop_advantage") >= gate.min_drop_advantage)


def _kept_reason(cfg: RunConfig) -> Column:
    mixed = F.col("pref.correct") != F.col("disp.correct")
    plain = F.when(mixed, F.lit("kept_mixed_correctness")).otherwise(F.lit("kept_same_correctness_utility_oriented"))
    if cfg.pair.pair_mode != "semi_purified":
        return plain
    right = F.when(_passes(cfg.pair.both_correct), "kept_both_correct_strong_local_preference").otherwise("dropped_both_correct_ambiguous")
    wrong = F.when(_passes(cfg.pair.both_wrong), "kept_both_wrong_delayed_error").otherwise("dropped_both_wrong_uninformative")
    gated = F.when(F.col("confidence") < cfg.pair.semi_purified_min_confidence, F.lit("dropped_same_correctness_low_confidence"))
    return F.when(mixed, plain).otherwise(F.coalesce(gated, F.when(F.col("pref.correct"), right).otherwise(wrong)))


def correctness_bucket(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "unresolved").when(a != b, "mixed_correctness").when(a, "both_correct").otherwise("both_wrong")


def correctness_pattern(pref: Column, disp: Column) -> Column:
    return F.when(pref & ~disp, "correct_vs_incorrect").when(~pref & disp, "incorrect_vs_correct").when(pref & disp, "both_correct").when(~pref & ~disp, "both_wrong").otherwise("unresolved")


def confidence_bucket(confidence: Column, cfg: RunConfig) -> Column:
    c = cfg.confidence
    return F.when(confidence.isNull(), "unknown").when(confidence < c.low_threshold, "low").when(confidence >= c.high_threshold, "high").otherwise("medium")


# --- decisions -------------------------------------------------------------------------------------------


def local_decisions(traces: DataFrame, cfg: RunConfig) -> DataFrame:
    """One row per comparison of two traces, with ``final_status`` and, for kept ones, ``training_weight``."""
    df = _infos(compared(traces, cfg), cfg)
    drop, reason, a_first = _orientation(cfg)
    early = F.when(F.col("k").isNull(), F.lit("dropped_no_divergence")).when(~F.col("there"), F.lit("dropped_empty_divergent_segment"))
    df = df.withColumn("early", F.coalesce(early, drop))
    oriented = F.col("early").isNull()
    df = df.withColumns({
        "pref": F.when(oriented, F.when(a_first, F.col("ia")).otherwise(F.col("ib"))),
        "disp": F.when(oriented, F.when(a_first, F.col("ib")).otherwise(F.col("ia"))),
        "a_first": F.when(oriented, a_first).otherwise(F.lit(True)),
        "orientation_reason": F.when(oriented, reason),
    })
    features = confidence_features(
        F.col("utility_margin"), F.col("pref.drop"), F.col("disp.drop"), F.col("pref.n"), F.col("disp.n"), F.col("pref.p"), F.col("disp.p"), cfg
    )
    df = df.withColumn("features", F.when(oriented, features))
    df = df.withColumns({"confidence": F.col("features.confidence"), "support_gap": F.col("pref.p") - F.col("disp.p"), "drop_advantage": F.col("disp.drop") - F.col("pref.drop")})
    df = df.withColumn("status", F.coalesce(F.col("early"), _kept_reason(cfg)))
    flag = lambda c: F.when(F.col("there"), F.col(c)).otherwise(F.lit(False))
    # what a decision shows comes before the cap: its sort then holds these columns (those that a plan uses), and no whole traces
    df = df.select(
        "id",
        F.concat_ws(":", "id", "k", "pref.trace_id", "disp.trace_id").alias("decision_id"),
        F.lit(cfg.pair.pair_mode).alias("pair_mode"),
        F.col("a.trace_id").alias("a_trace_id"),
        F.col("b.trace_id").alias("b_trace_id"),
        "prompt_ord",
        F.col("a.ord").alias("a_ord"),
        F.col("b.ord").alias("b_ord"),
        "k",
        F.when(F.col("k").isNotNull(), A.prefix(F.col("a.steps"), F.col("k"))).otherwise(F.array().cast("array<string>")).alias("prefix_steps_a"),
        F.coalesce(F.when(F.col("a_first"), F.col("seg_a")).otherwise(F.col("seg_b")), F.array().cast("array<string>")).alias("preferred_steps"),
        F.coalesce(F.when(F.col("a_first"), F.col("seg_b")).otherwise(F.col("seg_a")), F.array().cast("array<string>")).alias("dispreferred_steps"),
        F.when(F.col("a_first") | F.col("k").isNull(), A.prefix(F.col("a.steps"), F.coalesce("k", F.lit(0)))).otherwise(A.prefix(F.col("b.steps"), F.coalesce("k", F.lit(0)))).alias("prefix_steps"),
        F.col("pref.trace_id").alias("pref_trace_id"),
        F.col("disp.trace_id").alias("disp_trace_id"),
        F.col("pref.correct").alias("pref_final_correct"),
        F.col("disp.correct").alias("disp_final_correct"),
        correctness_bucket(F.col("a.final_correct"), F.col("b.final_correct")).alias("correctness_bucket"),
        correctness_pattern(F.col("pref.correct"), F.col("disp.correct")).alias("correctness_pattern"),
        "orientation_reason",
        "confidence",
        confidence_bucket(F.col("confidence"), cfg).alias("confidence_bucket"),
        "features",
        "utility_margin",
        F.col("local_gap").alias("local_score_gap"),
        F.col("pref.utility").alias("pref_utility"),
        F.col("disp.utility").alias("disp_utility"),
        F.col("pref.local").alias("pref_local_score"),
        F.col("disp.local").alias("disp_local_score"),
        F.col("pref.n").alias("n_pref"),
        F.col("disp.n").alias("n_other"),
        "support_gap",
        "drop_advantage",
        flag("weak").alias("weak_divergence"),
        F.when(F.col("there"), F.col("too_short") | F.col("exact_match")).otherwise(F.lit(False)).alias("degenerate_divergence"),
        flag("formatting_only").alias("formatting_only_divergence"),
        flag("near_identical").alias("near_identical_divergence"),
        flag("trivial_difference").alias("trivial_difference_divergence"),
        flag("boilerplate_only").alias("boilerplate_only_divergence"),
        flag("reconverges").alias("boundary_unstable"),
        F.when(F.col("there"), F.col("similarity")).alias("divergent_similarity"),
        F.when(F.col("there"), F.col("min_chars")).alias("divergent_min_chars"),
        "status",
    ).drop("prefix_steps_a")
    shown = [c for c in df.columns if c != "status"]
    best = Window.partitionBy("id", F.col("status").startswith(KEPT)).orderBy(F.desc("confidence"), "a_ord", "b_ord")
    kept = F.col("status").startswith(KEPT)
    capped = F.when(kept & (F.row_number().over(best) > cfg.pair.max_pairs_per_prompt), "dropped_prompt_pair_cap").otherwise(F.col("status"))
    df = df.withColumn("capped", capped)
    low = F.col("capped").startswith(KEPT) & (F.col("confidence") < cfg.threshold)
    df = df.withColumn("final_status", F.when(low, "dropped_low_confidence").otherwise(F.col("capped")))
    weight = F.col("confidence") if cfg.method.name == "confidence_weighted_step_dpo" else F.lit(1.0)
    return df.select(
        *shown,
        kept.alias("is_candidate"),
        (F.col("capped") != F.col("status")).alias("is_capped"),
        "final_status",
        F.when(F.col("final_status").startswith(KEPT), weight).alias("training_weight"),
    )


def answer_decisions(traces: DataFrame, cfg: RunConfig) -> DataFrame:
    """One row per (correct, incorrect) trace pair of a prompt: whole traces, best against worst first, capped. Means that are
    equal to nine digits are equal there, whatever the order in which their scores were added."""
    one = F.struct("ord", "trace_id", "steps", A.mean_score(F.col("step_scores")).alias("mean"))
    t = with_places(traces).select("id", "prompt_ord", "final_correct", one.alias("t"))
    right, wrong = t.where("final_correct").select("id", "prompt_ord", F.col("t").alias("p")), t.where("not final_correct").select("id", F.col("t").alias("d"))
    pairs = right.join(wrong, "id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("p.mean", 9).desc(), "p.ord", F.round("d.mean", 9), "d.ord"))
    kept = F.col("rank") <= cfg.pair.max_pairs_per_prompt
    none = F.lit(None)
    df = pairs.withColumn("rank", rank)
    return df.select(
        "id",
        F.concat_ws(":", "id", F.lit("answer"), "p.trace_id", "d.trace_id").alias("decision_id"),
        F.lit("answer_level").alias("pair_mode"),
        "prompt_ord",
        F.col("p.ord").alias("a_ord"),
        F.col("d.ord").alias("b_ord"),
        none.cast("int").alias("k"),
        F.array().cast("array<string>").alias("prefix_steps"),
        F.col("p.steps").alias("preferred_steps"),
        F.col("d.steps").alias("dispreferred_steps"),
        F.col("p.trace_id").alias("pref_trace_id"),
        F.col("d.trace_id").alias("disp_trace_id"),
        F.lit(True).alias("pref_final_correct"),
        F.lit(False).alias("disp_final_correct"),
        F.lit("mixed_correctness").alias("correctness_bucket"),
        F.lit("correct_vs_incorrect").alias("correctness_pattern"),
        F.lit("answer_level_final_correctness").alias("orientation_reason"),
        none.cast("double").alias("confidence"),
        F.lit("unknown").alias("confidence_bucket"),
        (F.col("p.mean") - F.col("d.mean")).alias("answer_score_margin"),
        *[F.lit(False).alias(c) for c in FLAGS],
        none.cast("int").alias("divergent_min_chars"),
        F.col("rank").alias("rank"),
        F.lit(True).alias("is_candidate"),
        (~kept).alias("is_capped"),
        F.when(kept, "kept_answer_level_mixed_correctness").otherwise("dropped_prompt_pair_cap").alias("final_status"),
        F.when(kept, F.lit(1.0)).alias("training_weight"),
    )


FLAGS = [
    "weak_divergence", "degenerate_divergence", "formatting_only_divergence", "near_identical_divergence", "trivial_difference_divergence",
    "boilerplate_only_divergence", "boundary_unstable",
]


def decisions(traces: DataFrame, cfg: RunConfig) -> DataFrame:
    return answer_decisions(traces, cfg) if cfg.pair_type == "answer_level" else local_decisions(traces, cfg)


def pairs(decided: DataFrame) -> DataFrame:
    """The kept rows."""
    return decided.where(F.col("final_status").startswith(KEPT))


def decision_order(decided: DataFrame) -> list[Column]:
    """The order in which comparisons are decided: prompts as they are first seen, then the places of both traces (of whole
    traces: best against worst)."""
    within = ["rank"] if "rank" in decided.columns else ["a_ord", "b_ord"]
    return [F.col("prompt_ord"), F.col("id"), *map(F.col, within)]


def training_order(kept: DataFrame) -> DataFrame:
    """Kept pairs with ``training_rank``, from 1: by confidence (else weight), then weight, falling; equal ones as they were
    decided. The place is a column, so that any reader can restore the order; no task sorts all pairs."""
    score = F.coalesce("confidence", "training_weight")
    return ranked(kept, [score.desc(), F.desc("training_weight"), *decision_order(kept)], "training_rank")


def training_table(kept: DataFrame, prompts: DataFrame) -> DataFrame:
    """Texts to train on: prompt with prefix, both segments, weight. ``prompts``: one row per id."""
    joined = kept.join(prompts.select("id", "prompt"), "id")
    return joined.select(
        "id",
        "decision_id",
        T.training_prefix(F.col("prompt"), F.col("prefix_steps")).alias("prefix_text"),
        T.segment_text(F.col("preferred_steps")).alias("preferred_text"),
        T.segment_text(F.col("dispreferred_steps")).alias("dispreferred_text"),
        F.col("training_weight").alias("weight"),
    )
