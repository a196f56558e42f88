"""Prefix trees, bounds of the similarity, order, audits, batches, step figures, data sets and final evaluation, each against a
plain restatement."""

import collections
import json
import math
import os
import random
import uuid
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracepairs import queries as Q
from tracepairs import queries_training as QT
from tracepairs.__main__ import main
from tracepairs.config import MethodConfig, PairConfig, RunConfig, TrainingConfig, from_dict
from tracepairs.functions import text as T
from tracepairs.functions.similarity import can_reach, near_identical, signature_similarity
from tracepairs.operators import pairs as P
from tracepairs.operators import sampling as S
from tracepairs.operators import training as B
from tracepairs.operators.order import ranked, running_sums
from tracepairs.operators.process_rows import process_rows_of
from tracepairs.operators.scoring import prefix_counts, register_scorer, score_traces, score_traces_in_batches, scorer
from tracepairs.plans import render
from tracepairs.sources.datasets import load_dataset, splits
from tracepairs.sources.jsonl import read_jsonl
from tracepairs.sources.stages import shared_folder, staged, staging

TRACE = "id string, prompt string, answer string, trace_id int, reasoning string, steps array<string>, final_answer string"


# --- prefix trees -------------------------------------------------------------------------------------------


def _traces(n, seed=0, prompts=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = rng.randrange(prompts)
        steps = [rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(0, 6))]
        rows.append((f"q{p}", f"prompt {p}", "1", i % 7, "", steps, "1"))
    return rows + [("q0", "prompt 0", "1", 99, "", None, "2"), ("q0", "prompt 0", "1", 98, "", ["a", None, "b"], "1"), ("q9", None, "1", 0, "", ["a", "b"], "1"), rows[0], rows[0]]


def _prefixes(rows):
    return [(r[1], "\n".join(x for x in (r[5] or [])[: i + 1] if x is not None)) for r in rows for i in range(len(r[5] or []))]


def _length_model():
    def make():
        def score(frames):
            for pdf in frames:
                assert list(pdf.columns) == ["prompt", "prefix"] and len(pdf) <= 5
                yield pdf["prefix"].str.len() + pdf["prompt"].fillna("none").str.len() / 100

        return score

    return make


def test_scores_of_the_tree_are_those_of_every_prefix(spark):
    rows = _traces(150)
    t = spark.createDataFrame(rows, TRACE).repartition(3)
    register_scorer("of_test", lambda prompt, prefix: F.length(prefix) + F.length(F.coalesce(prompt, F.lit("none"))) / 100)
    key = lambda df: sorted(((r.id, r.trace_id, r.steps, [round(x, 6) for x in r.step_scores], r.final_correct) for r in df.collect()), key=repr)
    got = score_traces_in_batches(t, _length_model(), max_rows=5)
    want = key(score_traces(t.where("steps IS NOT NULL"), scorer("of_test"))) + [("q0", 99, None, [], False)]
    assert key(got) == sorted(want, key=repr) and set(got.columns) == {*t.columns, "step_scores", "final_correct"}


def _counting_model():
    """Each call gives a number of its own, so different numbers count calls."""
    return lambda: lambda frames: (pd.Series([float(uuid.uuid4().int >> 75) for _ in range(len(pdf))]) for pdf in frames)


@pytest.mark.parametrize("parts", [1, 5])
def test_each_prefix_is_scored_once(spark, parts):
    rows = _traces(300, 1)
    different = len({(r[1], *r[5][: i + 1]) for r in rows for i in range(len(r[5] or []))})
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = score_traces_in_batches(spark.createDataFrame(rows, TRACE), _counting_model()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    calls = len({x for r in out for x in r.step_scores})
    longest = max(len(r[5] or []) for r in rows)
    assert different <= calls <= different + (parts - 1) * longest < 0.6 * len(_prefixes(rows))
    by_prefix = collections.defaultdict(set)
    for r in out:
        for i, x in enumerate(r.step_scores):
            by_prefix[r.prompt, tuple(r.steps[: i + 1])].add(x)
    assert sum(len(x) > 1 for x in by_prefix.values()) <= (parts - 1) * longest


def test_prefix_counts(spark):
    rows = [r for r in _traces(200, 2) if r[1] is not None and None not in (r[5] or [])]
    got = {r.prompt: (r.prefixes, r.different) for r in prefix_counts(spark.createDataFrame(rows, TRACE)).collect()}
    want = collections.defaultdict(list)
    for p, x in _prefixes(rows):
        want[p].append(x)
    assert got == {p: (len(x), len(set(x))) for p, x in want.items()}
    assert prefix_counts(spark.createDataFrame([], TRACE)).count() == 0


# --- similarity ---------------------------------------------------------------------------------------------


def test_bounds_of_the_similarity(spark):
    rng = random.Random(5)
    words = "the sum of all apples and pears is 12 + 7 = 19 é 日本 Zz".split()
    texts = ["", "a", "aa", "é", "日" * 250] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in rng.sample(texts, 12)] + [(t, t[: len(t) // 2] + "x" + t[len(t) // 2 :]) for t in texts] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (0.5, 0.94, 1.0):
        a, b = F.col("a"), F.col("b")
        rows = df.select("a", "b", signature_similarity("a", "b").alias("ratio"), can_reach(a, b, threshold).alias("can"), near_identical(a, b, threshold).alias("near")).collect()
        for r in rows:
            ratio = None if None in (r.a, r.b) else 1.0 if r.a == r.b else SequenceMatcher(None, r.a, r.b).ratio()
            assert r.ratio == ratio and r.near == (ratio is not None and ratio >= threshold), r
            assert r.can or ratio is None or ratio < threshold, r
        if threshold > 0.9:
            assert sum(bool(r.can) for r in rows) < len(rows) / 3


def test_similarity_is_computed_only_where_it_is_asked_for(spark, sf_dir):
    decided = P.decisions(Q.scored_traces(spark, sf_dir), Q.SIMILAR.with_mode("strict_purified"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(decided.select("final_status")).count("signature_similarity(") < plan(decided.select("final_status", "divergent_similarity")).count("signature_similarity(")


def test_forms_of_segments_are_computed_before_the_self_join(spark, sf_dir):
    """Once for each trace and position, not for each comparison."""
    decided = P.decisions(Q.scored_traces(spark, sf_dir), Q.SIMILAR.with_mode("semi_purified"))
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    above, join, below = plan.partition("Join Inner")
    assert join and all(x not in above and x in below for x in ("regexp_replace(", "translate("))


def test_forms_of_segments(spark):
    rng = random.Random(8)
    steps = ["Step 1: add 3 + 5", "step", "2. so, 8", "First, let us see", " ", "", "!!!", "the apples , and pears", "日本 é", None]
    traces = [(p, t, [rng.choice(steps) for _ in range(rng.randint(0, 5))], [], bool(t % 2)) for p in ("p", "q", "r") for t in range(12)]
    df = spark.createDataFrame(traces, "id string, trace_id int, steps array<string>, step_scores array<double>, final_correct boolean")
    there = P.compared(df, Q.SIMILAR).where("there")
    text = {x: T.segment_text(F.col(f"seg_{x}")) for x in "ab"}
    want = [T.segment_signature(F.col(f"seg_{x}")) for x in "ab"] + [T.alnum_signature(text["a"]) == T.alnum_signature(text["b"]), T.content_tokens(text["a"]) == T.content_tokens(text["b"]), T.has_math(text["a"]) | T.has_math(text["b"])]
    got = [F.col("form_a.s.sig"), F.col("form_b.s.sig"), F.col("formatting_only"), F.col("form_a.c.words") == F.col("form_b.c.words"), F.col("math")]
    rows = there.select(F.struct(*[w.alias(f"c{i}") for i, w in enumerate(want)]).alias("want"), F.struct(*[g.alias(f"c{i}") for i, g in enumerate(got)]).alias("got")).collect()
    assert len(rows) > 100 and all(r.want == r.got for r in rows)


# --- order, places, audits ----------------------------------------------------------------------------------


def test_ranks_and_sums_of_frequent_values(spark):
    rows = [(i, 0.5 if i % 3 else i / 1000, "hot" if i % 4 else f"b{i % 40}", i % 5) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, score double, bucket string, n long").repartition(6)
    order = [F.desc("score"), F.col("i")]
    got = {r.i: r["the.rank"] for r in ranked(df, order, "the.rank").collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    seen, want = collections.Counter(), {}
    for i, _, b, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[i] = seen[b]
        seen[b] += n
    assert {r.i: r.before for r in running_sums(df, order, {"before": F.col("n")}, ["bucket"]).collect()} == want
    assert ranked(df.limit(0), order).count() == 0


def test_training_order_follows_the_file(spark):
    """Equal pairs stand as their prompts are first seen in the file, then as they were compared."""
    rows = []
    for line, (prompt, trace) in enumerate([("z", 5), ("a", 2), ("z", 1), ("m", 0), ("a", 1), ("z", 3), ("m", 9)]):
        rows.append((prompt, trace, ["begin", f"then the {['red', 'green'][line % 2]} {line} goes on"], [0.5, 0.5 + trace % 2 / 4], trace % 2 == 1, line))
    t = spark.createDataFrame(rows, "id string, trace_id int, steps array<string>, step_scores array<double>, final_correct boolean, ord long")
    cfg = RunConfig(pair=PairConfig(tau_pair=0.0, min_weight=0.0, min_divergent_chars=1), method=MethodConfig("step_dpo"))
    for own in (cfg, cfg.with_method("answer_dpo")):
        kept = sorted(P.training_order(P.pairs(P.decisions(t, own))).collect(), key=lambda r: r.training_rank)
        first = {"z": 0, "a": 1, "m": 3}
        score = lambda r: r.confidence if r.confidence is not None else r.training_weight
        within = lambda r: (r["rank"],) if own.pair_type == "answer_level" else (r.a_ord, r.b_ord)  # noqa: B023, E731
        assert [r.training_rank for r in kept] == list(range(1, len(kept) + 1)) and len(kept) >= 2
        assert kept == sorted(kept, key=lambda r: (-score(r), -r.training_weight, first[r.id], within(r)))


def test_repeated_trace_ids(spark):
    """Each trace counts at its own place; scores are those of the last trace with its id."""
    rng = random.Random(4)
    rows = [(f"q{i % 3}", rng.randint(0, 2), [rng.choice(["go left", "go right"]) for _ in range(rng.randint(0, 4))], rng.random() < 0.5, i) for i in range(30)]
    rows = [(p, t, s, [rng.random() for _ in s], ok, i) for p, t, s, ok, i in rows]
    schema = "id string, trace_id int, steps array<string>, step_scores array<double>, final_correct boolean, ord long"
    got = {r.ord: r for r in P.prepare(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    assert len(got) == 30
    for p, t, steps, _, _, i in rows:
        group = [r for r in rows if r[0] == p]
        flat = [x for r in group for x in r[3]]
        mean = sum(flat) / len(flat)
        std = math.sqrt(sum((x - mean) ** 2 for x in flat) / len(flat)) + 1e-6
        last = [r for r in group if r[1] == t][-1]
        assert got[i].z == pytest.approx([(x - mean) / std for x in last[3]])
        for k, step in enumerate(steps):
            same = [r for r in group if len(r[2]) > k and r[2][k] == step]
            assert got[i].support[k].n == len(same) and got[i].support[k].p == pytest.approx(sum(r[4] for r in same) / len(same))
        assert len(got[i].support) == len(steps) and got[i].prompt_ord == min(r[5] for r in group)
    without = spark.createDataFrame([r[:5] for r in rows], schema.rpartition(",")[0])
    decided = P.decisions(without, RunConfig())
    assert decided.count() == 3 * 45 and decided.select("id", "a_ord", "b_ord").distinct().count() == 3 * 45


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_shuffles_are_followed_by_numbers(monkeypatch, block):
    monkeypatch.setattr(S, "_BLOCK", block)
    for seed, n in enumerate([0, 1, 2, 3, 7, 8, 15, 50, 400]):
        for k in (0, 1, 5, 1000):
            own, plain, order = random.Random(seed), random.Random(seed), list(range(n))
            plain.shuffle(order)
            assert S.shuffled_ordinals(own, n, k) == order[:k]
            assert own.random() == plain.random()


def test_audit_is_that_of_one_generator(spark):
    rows = [(i, ["low", "medium", "high", "unknown"][(i * i) % 7 % 4], -i) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, bucket string, o long").repartition(5)
    got = S.audit_sample(df, "bucket", ["low", "medium", "high", "none"], [F.col("o")], 8, 42)
    rng, want = random.Random(42), []
    for bucket in ("low", "medium", "high"):
        own = [r[0] for r in sorted(rows, key=lambda r: r[2]) if r[1] == bucket]
        rng.shuffle(own)
        want += [(bucket, place, i) for place, i in enumerate(own[:8])]
    assert sorted((r.bucket, r.place, r.i) for r in got.collect()) == sorted(want)
    assert S.audit_sample(df.limit(0), "bucket", ["low"], [F.col("o")], 8, 42).count() == 0


def test_staged_tables_go(spark):
    here = lambda: {x for x in os.listdir(shared_folder(spark).removeprefix("file://")) if x.startswith("mine")}
    with staging(spark):
        assert staged(spark.range(3), "mine").count() == 3 and len(here()) == 1
    assert not here()

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster)


def test_line_ordinals_of_many_splits(spark, tmp_path):
    for name, lines in (("b", range(40, 90)), ("a", range(40))):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"i": i, "t": "x" * (i % 9)}) for i in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = S.with_line_ordinals(spark.read.schema("i long").json(str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.i: r.ord for r in rows} == {i: i for i in range(90)} and len(rows) == 90


# --- batches and steps --------------------------------------------------------------------------------------

ENCODED = "i long, prefix_ids array<int>, pref_ids array<int>, disp_ids array<int>, weight double"


def _encoded(spark, n, seed=0):
    rng = random.Random(seed)
    ids = lambda m: [rng.randint(0, 9) for _ in range(rng.randint(0, m))]
    rows = [(i, ids(6), ids(4), ids(9), rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, ENCODED).repartition(3), rows


def _pad(rows, c, pad):
    m = max(len(r[c]) for r in rows)
    return [r[c] + [pad] * (m - len(r[c])) for r in rows], [[1] * len(r[c]) + [0] * (m - len(r[c])) for r in rows]


@pytest.mark.parametrize("n,size", [(0, 3), (1, 3), (23, 4), (24, 4), (9, 1)])
def test_batches(spark, n, size):
    df, rows = _encoded(spark, n)
    got = B.collated(B.in_batches(df, [F.desc("i")], batch_size=size), -1).orderBy("batch").collect()
    cut = [rows[::-1][i : i + size] for i in range(0, n, size)]
    assert [r.batch for r in got] == list(range(len(cut)))
    for r, own in zip(got, cut):
        for c, name in ((1, "prefix_ids"), (2, "pref_ids"), (3, "disp_ids")):
            assert (r[name], r[f"{name}_mask"]) == _pad(own, c, -1)
        assert r.weights == pytest.approx([x[4] for x in own], rel=1e-6)


def test_batches_by_tokens(spark):
    df, rows = _encoded(spark, 40, 3)
    df = df.withColumn("pref_ids", F.when(F.col("i") == 11, F.array_repeat(F.lit(1), 200)).otherwise(F.col("pref_ids")))
    got = {r.i: (r.batch, r.place) for r in B.in_batches(df, [F.col("i")], max_tokens=50).collect()}
    total, cuts = 0, []
    for r in rows:
        cuts.append(total // 50)
        total += len(r[1]) + (200 if r[0] == 11 else len(r[2])) + len(r[3])
    numbers = {c: i for i, c in enumerate(sorted(set(cuts)))}
    assert got == {i: (numbers[c], cuts[:i].count(c)) for i, c in enumerate(cuts)} and max(cuts) > max(numbers.values())
    for wrong in ({}, {"batch_size": 2, "max_tokens": 3}, {"batch_size": 0}, {"max_tokens": -1}):
        with pytest.raises(ValueError):
            B.in_batches(df, [F.col("i")], **wrong)


def test_epochs_are_shuffled_alike_whatever_the_partitions(spark):
    df, _ = _encoded(spark, 60)
    order = lambda d, epoch: [r.i for r in ranked(d, B.epoch_order(3, epoch, "i")).orderBy("rank").collect()]
    assert order(df, 1) == order(df.repartition(7), 1) != order(df, 2) and sorted(order(df, 2)) == list(range(60))


def test_token_ids_are_cut(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], None, [], 1.0)], ENCODED)
    assert B.truncated(df, 2).first()[1:4] == ([1, 2], [], [])


def _trained(losses, accumulation, epochs, lr, warmup_ratio):
    """A training loop's log: (step, epoch, batches, last loss, rate)."""
    batches = len(losses[0])
    total = math.ceil(batches / accumulation) * epochs
    warmup, log, step = int(total * warmup_ratio), [], 0

    def rate(done):
        return lr * (done / max(1, warmup) if done < warmup else max(0.0, 0.5 * (1 + math.cos(math.pi * (done - warmup) / max(1, total - warmup)))))

    for e in range(epochs):
        waiting = []
        for i, loss in enumerate(losses[e], start=1):
            waiting.append(loss)
            if i % accumulation == 0 or i == batches:
                step += 1
                log.append((step, e + 1, len(waiting), loss, sum(waiting) / len(waiting), rate(step - 1)))
                waiting = []
    return log


@pytest.mark.parametrize("batches,accumulation,epochs", [(1, 8, 1), (7, 3, 2), (8, 4, 3), (5, 1, 1)])
def test_steps_are_those_of_the_loop(spark, batches, accumulation, epochs):
    rng = random.Random(batches)
    cfg = RunConfig(training=TrainingConfig(grad_accum_steps=accumulation, num_epochs=epochs, lr=0.01, warmup_ratio=0.3, batch_size=2))
    runs = {run: [[rng.random() for _ in range(batches)] for _ in range(epochs)] for run in ("a", "b")}
    rows = [(run, e + 1, i + 1, loss, loss / 2, None if run == "a" else loss / 4) for run, ls in runs.items() for e, own in enumerate(ls) for i, loss in enumerate(own)]
    df = spark.createDataFrame(rows, "run string, epoch int, batch int, loss double, dpo_term double, ref_pen double").repartition(3)
    for run, losses in runs.items():
        got = B.optimizer_steps(df.where(F.col("run") == run), cfg, moving=2).orderBy("step").collect()
        want = _trained(losses, accumulation, epochs, 0.01, 0.3)
        assert [(r.step, r.epoch, r.batches) for r in got] == [w[:3] for w in want]
        assert [x for r in got for x in (r.loss, r.mean_loss, r.learning_rate)] == pytest.approx([x for w in want for x in w[3:]])
        assert [r.moving_loss for r in got] == pytest.approx([(w[3] + want[max(0, i - 1)][3]) / 2 for i, w in enumerate(want)])
        assert [r.ref_pen for r in got] == pytest.approx([0.0 if run == "a" else w[3] / 4 for w in want])
        s = B.training_summary(df, cfg).where(F.col("run") == run).first()
        flat = [x for own in losses for x in own]
        assert (s.num_batches, s.num_steps, s.effective_batch_size) == (batches, len(want), 2 * accumulation)
        assert (s.mean_loss, s.mean_dpo_term, s.mean_ref_pen) == pytest.approx((sum(flat) / len(flat), sum(flat) / len(flat) / 2, 0.0 if run == "a" else sum(flat) / len(flat) / 4))


def test_training_report(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"training": {"grad_accum_steps": 2, "batch_size": 3, "num_epochs": 1, "model_name": "base"}}))
    lines = [{"run": run, "epoch": 1, "batch": i + 1, "loss": 0.5 * i} for run in "ba" for i in range(5)]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    main(["steps", "--config", str(tmp_path / "run.json"), "--metrics", str(tmp_path / "m.jsonl"), "--out", str(tmp_path / "out")])
    runs = json.loads((tmp_path / "out" / "training.json").read_text())["runs"]
    assert [(r["run"], r["num_batches"], r["num_steps"], r["effective_batch_size"], r["mean_loss"], r["mean_dpo_term"], r["base_model_name"]) for r in runs] == [(x, 5, 3, 6, 1.0, None, "base") for x in "ab"]
    assert [(r.step, r.loss) for r in spark.read.parquet(str(tmp_path / "out" / "steps")).where("run = 'a'").orderBy("step").collect()] == [(1, 0.5), (2, 1.5), (3, 2.0)]
    assert "## b" in (tmp_path / "out" / "training.md").read_text()
    assert render.training_report([]) == "# Training\n\nNo batches.\n"


# --- data sets, gold rows, final evaluation --------------------------------------------------------------------


@pytest.fixture
def root(spark, tmp_path):
    rows = spark.range(50).selectExpr("concat('q', id) AS question", "concat('s #### ', id) AS answer", "id AS more")
    base = f"{tmp_path}/data/some/sums"
    rows.repartitionByRange(3, "more").sortWithinPartitions("more").write.parquet(f"{base}/main/train")
    rows.coalesce(1).write.json(f"{base}/main/test")
    rows.where("more < 7").coalesce(1).write.parquet(f"{base}/other/train")
    return f"{tmp_path}/data"


def test_data_sets(spark, root):
    columns = "question string, answer string"
    read = lambda split, **more: load_dataset(spark, root, "some/sums", "main", split, columns, **more).orderBy("ord").collect()
    numbers = lambda split: [(r.ord, int(r.question[1:])) for r in read(split)]
    assert numbers("train") == numbers("test") == [(i, i) for i in range(50)]
    assert numbers("train[:4]") == [(i, i) for i in range(4)] and numbers("test[10%:20%]") == [(i, 5 + i) for i in range(5)]
    assert numbers("train[-3:]") == [(0, 47), (1, 48), (2, 49)] and numbers("train[60:]") == [] and numbers("train[9:3]") == []
    assert numbers("train[:2]+test[48:]") == [(0, 0), (1, 1), (2, 48), (3, 49)]
    assert load_dataset(spark, root, "some/sums", "other").count() == 7
    assert set(splits(spark, root, "some/sums", "main")) == {"train", "test"}
    plan = load_dataset(spark, root, "some/sums", "main", "train", columns).select("question")._jdf.queryExecution().executedPlan().toString()
    assert "answer" not in plan.split("ReadSchema")[1].split(">")[0]


def test_files_of_a_data_set_do_not_grow(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, QT.dataset_slices(spark, sf_dir).collect()))
    monkeypatch.setattr(QT, "_FILE_ROWS", 100)
    df = QT.dataset_slices(spark, sf_dir)
    assert sorted(map(tuple, df.collect())) == want
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    for split in ("train", "test"):
        assert sum(f"/{split}/" in f for f in df.inputFiles()) == math.ceil(n / 100)


def test_data_sets_that_are_not_there(spark, root):
    for name, config, split, schema, message in (
        ("none", "main", "train", None, "no data set"), ("some/sums", "mine", "train", None, "configuration 'mine'.*main, other"), ("some/sums", None, "train", None, "configuration None"),
        ("some/sums", "main", "dev", None, "split 'dev'.*test, train"), ("some/sums", "main", "train[", None, "not a name"), ("some/sums", "main", "train", "wanted string", "no column wanted"),
    ):
        with pytest.raises(ValueError, match=message):
            load_dataset(spark, root, name, config, split, schema)


def test_preparation_from_a_data_set(spark, root, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("prompt_file", "eval_prompt_file")}
    run = {"paths": paths, "data": {"dataset_name": "some/sums", "dataset_config_name": "main", "max_train_prompts": 5, "max_eval_prompts": 4, "prompt_sampling_seed": 1}}
    (tmp_path / "run.json").write_text(json.dumps(run))
    main(["prepare", "--config", str(tmp_path / "run.json"), "--datasets", root])
    assert sorted(int(r.answer) for r in read_jsonl(spark, paths["prompt_file"], "prompt").collect()) == sorted(random.Random(1).sample(range(50), 5))
    with pytest.raises(ValueError, match="--train"):
        main(["prepare", "--config", str(tmp_path / "run.json")])


def test_gold_rows_do_not_depend_on_other_rows(spark):
    table = spark.range(400).repartition(7)
    make = lambda df, seed: {r.id: r for r in process_rows_of(df, F.col("id").cast("string"), F.col("id"), seed).collect()}
    whole = make(table, 3)
    assert len(whole) == 400 and make(table.where("id % 10 = 3"), 3) == {i: r for i, r in whole.items() if i % 10 == 3}
    assert make(table, 4) != whole and len({r.prompt for r in whole.values()}) > 300
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "x")], "i long, k string")
    a, b, c, d = sorted(process_rows_of(odd, F.col("k"), F.col("i"), 1).collect())
    assert a[1:] == b[1:] and c[1:] == d[1:] != a[1:]


def test_final_evaluation(spark, tmp_path):
    prompts = [{"id": f"p{i}", "prompt": "q", "answer": str(i)} for i in range(6)]
    outputs = [{"id": f"p{i}", "output": f"So it is.\nThe answer is {i if i % 2 else i + 1}."} for i in range(5)] + [{"id": "other", "output": "1"}]
    for name, rows in (("prompts", prompts), ("outputs", outputs)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    run = {"paths": {"prompt_file": str(tmp_path / "prompts.jsonl"), "checkpoint_dir": str(tmp_path / "ck")}, "training": {"model_name": "base", "lr": "2e-5"}}
    (tmp_path / "run.json").write_text(json.dumps(run))
    command = ["final", "--config", str(tmp_path / "run.json"), "--predictions", str(tmp_path / "outputs.jsonl"), "--out", str(tmp_path / "out")]
    report = lambda: json.loads((tmp_path / "out" / "final_eval.json").read_text())
    main(command)
    assert report() == {"model_name": "base", "base_model_name": "base", "adapter_path": None, "adapter_loaded": False, "accuracy": 2 / 6, "num_correct": 2, "num_examples": 6, "num_missing": 1}
    graded = {r.id: (r.gold, r.correct) for r in spark.read.parquet(str(tmp_path / "out" / "graded")).collect()}
    assert graded == {f"p{i}": (str(i), i in (1, 3)) for i in range(6)}
    (tmp_path / "ck" / "final").mkdir(parents=True)
    main(command)
    assert report()["model_name"] == f"{tmp_path}/ck/final" and not report()["adapter_loaded"]
    (tmp_path / "ck" / "final" / "adapter_config.json").write_text("{}")
    main(command)
    assert report()["adapter_path"] == f"{tmp_path}/ck/final"
    main([*command, "--model-name", "mine"])
    assert report()["model_name"] == "mine" and report()["adapter_path"] is None
    assert from_dict(run).training.lr == 2e-5


def test_process_evaluation_of_given_pairs(spark, tmp_path):
    """Gold rows without traces are judged by the pairs of a run."""
    rows = []
    for q in "ab":
        rows += [(q, 0, ["first add the apples", "then count them all"], [0.9, 0.9], True), (q, 1, ["first add the apples", "then lose some pears"], [0.9, 0.1], False)]
    traces = spark.createDataFrame(rows, "id string, trace_id int, steps array<string>, step_scores array<double>, final_correct boolean")
    cfg = RunConfig(pair=PairConfig(pair_mode="correctness_priority", tau_pair=0.0, min_weight=0.0, min_divergent_chars=1))
    P.training_order(P.pairs(P.decisions(traces, cfg))).write.parquet(str(tmp_path / "pairs"))
    (tmp_path / "gold.jsonl").write_text("\n".join(json.dumps({"id": i, "gold_earliest_error_step": g}) for i, g in (("a", 1), ("b", 0), ("c", 2))))
    for method in ("step_dpo", "answer_dpo"):
        (tmp_path / "run.json").write_text(json.dumps({"method": {"name": method}}))
        main(["process", "--config", str(tmp_path / "run.json"), "--gold", str(tmp_path / "gold.jsonl"), "--report", str(tmp_path / "r.json"), "--pairs", str(tmp_path / "pairs")])
        report = json.loads((tmp_path / "r.json").read_text())
        if method == "answer_dpo":
            assert report["not_applicable"] and report["num_evaluated_examples"] == 3
        else:
            assert report["scope"] == "pairs of a run" and report["metrics"]["num_evaluated_examples"] == 3
            assert (report["metrics"]["num_correct"], report["metrics"]["coverage"], report["metrics"]["earliest_error_near_miss"]) == (1, 2 / 3, 2 / 3)
    with pytest.raises(ValueError, match="--pairs"):
        main(["process", "--config", str(tmp_path / "run.json"), "--gold", str(tmp_path / "gold.jsonl"), "--report", "x"])
