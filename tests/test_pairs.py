"""Decisions against a row-at-a-time restatement of the rules, and single cases."""

import dataclasses
import random
import re
from difflib import SequenceMatcher

import pytest

from tracepairs.config import PAIR_MODES, ConfidenceConfig, MethodConfig, PairConfig, RunConfig, from_dict
from tracepairs.functions.text import PREAMBLE, STOPWORDS
from tracepairs.operators import pairs as P
from tracepairs.operators import process_eval as E
from tracepairs.operators import reports as R

SCHEMA = "id string, trace_id int, steps array<string>, step_scores array<double>, final_correct boolean"
CFG = RunConfig(pair=PairConfig(tau_pair=0.05, min_weight=0.0, max_pairs_per_prompt=10, min_divergent_chars=8, max_near_identical_similarity=0.9))


def traces(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def statuses(df):
    return [r.final_status for r in df.select("final_status").collect()]


SHARED = [("q", 0, ["find the price", "double the amount", "the sum is 20"], [0.9, 0.85, 0.92], True), ("q", 1, ["find the price", "double the amount", "the sum is 99 now"], [0.9, 0.4, 0.1], False)]


def test_right_trace_is_preferred_after_the_shared_prefix(spark):
    (row,) = P.pairs(P.decisions(traces(spark, SHARED), CFG)).collect()
    assert (row.k, row.pref_trace_id, row.disp_trace_id, row.prefix_steps) == (2, 0, 1, SHARED[0][2][:2])
    assert row.preferred_steps == ["the sum is 20"] and 0.5 < row.confidence <= 1 and row.training_weight == row.confidence


def test_methods(spark):
    t = traces(spark, SHARED)
    (row,) = P.pairs(P.decisions(t, CFG.with_method("step_dpo"))).collect()
    assert row.training_weight == 1.0 and row.confidence is not None
    (row,) = P.pairs(P.decisions(t, CFG.with_method("answer_dpo"))).collect()
    assert row.prefix_steps == [] and row.preferred_steps == SHARED[0][2] and row.confidence is None
    strict = dataclasses.replace(CFG, method=MethodConfig("confidence_filter_only", 0.99))
    assert statuses(P.decisions(t, strict)) == ["dropped_low_confidence"]


def test_single_outcomes(spark):
    prefix = [("q", 0, ["a one", "b two"], [0.5, 0.5], True), ("q", 1, ["a one"], [0.5], False)]
    assert statuses(P.decisions(traces(spark, prefix), CFG)) == ["dropped_empty_divergent_segment"]
    wrong = [("q", 0, ["count the red apples"], [0.9], False), ("q", 1, ["divide by the pears"], [0.1], False)]
    assert statuses(P.decisions(traces(spark, wrong), CFG.with_mode("strict_purified"))) == ["dropped_both_wrong_uninformative"]
    assert statuses(P.decisions(traces(spark, wrong), CFG.with_mode("semi_purified"))) == ["dropped_same_correctness_low_confidence"]
    same = [("q", 0, ["it is 54000."], [0.9], True), ("q", 1, ["it is $54,000."], [0.1], False)]
    assert statuses(P.decisions(traces(spark, same), CFG.with_mode("strict_purified"))) == ["dropped_no_divergence"]
    flipped = [("q", 0, ["count the red apples"], [0.1], True), ("q", 1, ["divide by the pears"], [0.9], False)]
    assert P.pairs(P.decisions(traces(spark, flipped), CFG)).first().pref_trace_id == 1
    assert P.pairs(P.decisions(traces(spark, flipped), CFG.with_mode("correctness_priority"))).first().pref_trace_id == 0


def test_similar_segments_are_dropped_by_similarity_alone(spark):
    a, b = "add the seventeen red apples to the basket", "add the seventeen red apples to the baskets"
    rows = [("q", 0, [a], [0.9], True), ("q", 1, [b], [0.1], False)]
    for mode in ("strict_purified", "semi_purified"):
        cfg = CFG.with_mode(mode)
        (row,) = P.decisions(traces(spark, rows), cfg).collect()
        assert row.final_status == "dropped_near_identical" and row.divergent_similarity == SequenceMatcher(None, a, b).ratio()
        loose = dataclasses.replace(cfg, pair=dataclasses.replace(cfg.pair, max_near_identical_similarity=0.995))
        assert statuses(P.decisions(traces(spark, rows), loose)) == ["kept_mixed_correctness"]


def _split_sums(prompts):
    """Per prompt a right trace and two wrong ones of equal score sums, cut at different places."""
    rng, out = random.Random(3), []
    for i in range(prompts):
        x, y, d = (rng.randint(5, 40) / 100 for _ in range(3))
        out += [(f"q{i}", 0, ["count the red apples", "add the green ones"], [0.9, 0.8], True), (f"q{i}", 1, ["divide by all the pears", "it is seven"], [x, y + d], False), (f"q{i}", 2, ["take the plums away", "it is eleven"], [x + d, y], False)]
    return out


def test_answers_with_equal_means_follow_their_places(spark):
    t = traces(spark, _split_sums(150))
    found = P.decisions(t, CFG.with_method("answer_dpo")).select("rank", "disp_trace_id").distinct().collect()
    assert {tuple(r) for r in found} == {(1, 1), (2, 2)}


def test_the_cap_sorts_no_whole_traces(spark):
    d = P.decisions(traces(spark, SHARED), CFG).select("id", "confidence", "final_status")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "row_number" in line and "Window" in line)
    below = plan.split(window, 1)[1].lstrip().splitlines()[0]  # what the sort of the window holds
    assert "Project" in below and "step_scores" not in below and " AS a#" not in below and ", a#" not in below and ", b#" not in below and "[a#" not in below
    assert d.columns == ["id", "confidence", "final_status"] and d.count() == 1


def test_empty_tables(spark):
    t = traces(spark, [])
    d = P.decisions(t, CFG)
    assert d.count() == 0
    row = R.purity_report(d, CFG).first()
    assert row.num_trace_comparisons == 0 and row.fraction_ambiguous_pairs is None and row.weak_divergence_fraction == 0.0
    assert R.bucket_summary(P.pairs(d), CFG).count() == 3


# --- the rules, one comparison at a time -------------------------------------------------------------------


def canon(s):
    s = re.sub(r"^step\s*\d+[:.)-]?\s*", "", s.lower().strip())
    return re.sub(r"[^\w\s.+\-*/=]", "", re.sub(r"\s+", " ", s))


def expected(rows, cfg):
    p, out, groups = cfg.pair, {}, {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for gid, group in groups.items():
        flat = [x for r in group for x in r[3]]
        mu = sum(flat) / len(flat)
        sd = (sum((x - mu) ** 2 for x in flat) / len(flat)) ** 0.5 + 1e-6
        z = {r[1]: [(x - mu) / sd for x in r[3]] for r in group}
        c = {r[1]: [canon(s) for s in r[2]] for r in group}
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                ca, cb = c[a[1]], c[b[1]]
                k = next((j for j, (x, y) in enumerate(zip(ca, cb)) if x != y), None if len(ca) == len(cb) else min(len(ca), len(cb)))
                key = (gid, a[1], b[1])
                if k is None or not ca[k:] or not cb[k:]:
                    out[key] = ("dropped_no_divergence" if k is None else "dropped_empty_divergent_segment", None)
                    continue
                side = {}
                for name, t in (("a", a), ("b", b)):
                    seg = z[t[1]][k : k + p.window_H]
                    local = sum(seg) / len(seg)
                    text = "\n".join(t[2][k : k + p.window_H]).strip()
                    ct = canon(text)
                    side[name] = {
                        "u": p.alpha_local * local + (1 - p.alpha_local) * t[4], "local": local, "drop": max(0.0, z[t[1]][k - 1] - z[t[1]][k]) if 0 < k < len(z[t[1]]) else 0.0,
                        "sig": " ".join(" ".join(c[t[1]][k : k + p.window_H]).split()), "ok": t[4], "trace": t[1], "alnum": "".join(x for x in ct if x.isalnum()),
                        "words": {w for w in ct.split() if len(w) >= 3 and w not in STOPWORDS}, "math": bool(re.search(r"[\d+*/=-]", ct)), "pre": any(w in ct for w in PREAMBLE),
                        "tail": c[t[1]][k + 1 : k + p.window_H], "same": [r for r in group if len(c[r[1]]) > k and c[r[1]][k] == c[t[1]][k]],
                    }
                x, y = side["a"], side["b"]
                math = x["math"] or y["math"]
                ratio = SequenceMatcher(None, x["sig"], y["sig"]).ratio() if x["sig"] or y["sig"] else 1.0
                short = min(len(x["sig"]), len(y["sig"])) < p.min_divergent_chars
                status = None
                if p.pair_mode in ("strict_purified", "semi_purified"):
                    if x["alnum"] == y["alnum"]:
                        status = "dropped_formatting_only"
                    elif ratio >= p.max_near_identical_similarity:
                        status = "dropped_near_identical"
                    elif x["tail"] and x["tail"] == y["tail"]:
                        status = "dropped_unstable_boundary"
                    elif short or (x["words"] == y["words"] and not math) or (x["pre"] and y["pre"] and not math):
                        status = "dropped_trivial_segment_difference"
                mixed, margin = x["ok"] != y["ok"], abs(x["u"] - y["u"])
                if status is None:
                    if p.pair_mode == "strict_purified" and not mixed:
                        status = "dropped_both_correct_ambiguous" if x["ok"] else "dropped_both_wrong_uninformative"
                    elif p.pair_mode != "strict_purified" and (p.pair_mode == "current_utility" or not mixed) and margin < p.tau_pair:
                        status = "dropped_utility_margin_below_tau_pair"
                if status:
                    out[key] = (status, None)
                    continue
                first = x["u"] >= y["u"] if p.pair_mode == "current_utility" or not mixed else x["ok"]
                w, l = (x, y) if first else (y, x)
                sg = lambda v: 1 / (1 + 2.718281828459045 ** -v)
                n1, n2 = len(w["same"]), len(l["same"])
                gap = sum(r[4] for r in w["same"]) / n1 - sum(r[4] for r in l["same"]) / n2
                q = cfg.confidence
                conf = 0.4 * sg((margin - q.tau_margin) / q.scale_margin) + 0.2 * sg((l["drop"] - w["drop"]) / q.scale_drop) + 0.2 * n1 / (n1 + n2 + 1e-6) + 0.2 * min(1, max(0, (1 + gap) / 2))
                status = "kept_mixed_correctness" if mixed else "kept_same_correctness_utility_oriented"
                if p.pair_mode == "semi_purified" and not mixed:
                    g = p.both_correct if x["ok"] else p.both_wrong
                    ok = margin >= g.min_utility_margin and abs(x["local"] - y["local"]) >= g.min_local_gap and conf >= g.min_confidence and gap >= g.min_support_gap and (g.min_drop_advantage is None or l["drop"] - w["drop"] >= g.min_drop_advantage)
                    kept = "kept_both_correct_strong_local_preference" if x["ok"] else "kept_both_wrong_delayed_error"
                    status = "dropped_same_correctness_low_confidence" if conf < p.semi_purified_min_confidence else kept if ok else ("dropped_both_correct_ambiguous" if x["ok"] else "dropped_both_wrong_uninformative")
                out[key] = (status, w["trace"])
    return out


STEPS = ["Let us see, step by step", "add 2 and 3", "add 2 and 3!", "Add 2, and 4", "take the large box of pens", "take the large box of pans", "then stop", "x", "The results are 12.", "we need to divide the amount"]


@pytest.mark.parametrize("mode", PAIR_MODES)
def test_decisions_follow_the_rules(spark, mode):
    rng = random.Random(5)
    rows = [(f"p{i}", t, s := [rng.choice(STEPS) for _ in range(rng.randint(1, 5))], [rng.random() for _ in s], rng.random() < 0.5) for i in range(12) for t in range(6)]
    cfg = dataclasses.replace(CFG, pair=dataclasses.replace(CFG.pair, pair_mode=mode, max_pairs_per_prompt=100, semi_purified_min_confidence=0.55), confidence=ConfidenceConfig())
    got = {(r.id, r.a_trace_id, r.b_trace_id): (r.final_status, r.pref_trace_id) for r in P.decisions(traces(spark, rows), cfg).collect()}
    assert got == expected(rows, cfg)
    assert len({s for s, _ in got.values()}) > 3


def test_earliest_error(spark):
    kept = spark.createDataFrame([("a", 1, 0.4, 0.4, 0, 1), ("a", 2, 0.8, 0.1, 0, 2), ("b", 0, 0.5, 0.5, 0, 1)], "id string, k int, confidence double, training_weight double, a_ord long, b_ord long")
    gold = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "id string, gold_earliest_error_step int")
    judged = E.judge(E.predict(kept), gold)
    m = E.metrics(judged).first()
    assert (m.earliest_error_exact, m.earliest_error_near_miss, m.coverage) == (pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert [r.id for r in E.failures(judged).collect()] == ["b", "c"]


def test_config():
    cfg = from_dict({"pair": {"pair_mode": "semi_purified", "both_wrong": {"min_confidence": 0.9}}, "method": {"name": "step_dpo"}})
    assert cfg.pair.both_wrong.min_confidence == 0.9 and cfg.pair.both_wrong.min_local_gap == 0.35 and cfg.threshold == 0.0
    with pytest.raises(ValueError):
        from_dict({"pair": {"pair_mode": "other"}})
