"""Sources, the whole run, and every query against its SQL."""

import dataclasses
import json
import os
import random
import re

import duckdb
import pytest

from tracepairs import queries as Q
from tracepairs.__main__ import main
from tracepairs.config import PairConfig, ResumeConfig, RunConfig, from_dict, load_config
from tracepairs.operators import pairs as P
from tracepairs.operators import reports as R
from tracepairs.operators import sampling as S
from tracepairs.operators.scoring import generate_traces, length_scorer, score_traces_in_batches
from tracepairs.plans import pipeline
from tracepairs.sources.jsonl import read_jsonl, write_jsonl

SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def views(sf_dir):
    con = duckdb.connect()
    for name in ("events", "documents", "conversations", "lineitem", "orders", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf_dir, views, name):
    df = Q.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert len(rows) > 0
    if name in SQL:
        want = views.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        cols = sorted(df.columns)
        at = [want.columns.index(c) for c in cols]
        assert sorted(repr([_plain(r[c]) for c in cols]) for r in rows) == sorted(repr([_plain(x[i]) for i in at]) for x in want.fetchall())


def test_jsonl(spark, tmp_path):
    lines = ['{"id": "a", "prompt": "p", "answer": "1", "extra": 2}', "", '{"id": "b", "prompt": "q", "answer": "2", "source_split": "s"}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    df = read_jsonl(spark, str(tmp_path / "in.jsonl"), "prompt")
    assert sorted((r.id, r.source_split) for r in df.collect()) == [("a", None), ("b", "s")]
    write_jsonl(df, str(tmp_path / "out"), single_file=True)
    assert read_jsonl(spark, str(tmp_path / "out"), "prompt").count() == 2
    (tmp_path / "bad.jsonl").write_text(json.dumps({"id": "a", "prompt": None, "answer": "1"}))
    with pytest.raises(Exception, match="without prompt"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl"), "prompt").collect()


def test_seeded_sample_is_that_of_the_generator(spark):
    df = spark.range(50).withColumnRenamed("id", "ord")
    assert sorted(r.ord for r in S.sample_rows(df, 7, 3).collect()) == sorted(random.Random(3).sample(range(50), 7))
    assert S.sample_rows(df, None, 3).count() == 50


def test_process_evaluation_run(spark, tmp_path):
    gold = S.process_rows(spark, 12, 1)
    cfg = RunConfig(pair=PairConfig(pair_mode="correctness_priority", tau_pair=0.05, min_weight=0.0))
    out = pipeline.evaluate_process(spark, gold, cfg, length_scorer, str(tmp_path / "run"))
    assert out["metrics"]["earliest_error_exact"] == 1.0 and out["metrics"]["coverage"] == 1.0
    from tracepairs.operators.process_eval import expand_gold

    result = pipeline.run_pairs(spark, expand_gold(gold), cfg, str(tmp_path / "run2"), scorer=length_scorer, gold=gold)
    pipeline.write_reports(result, cfg, str(tmp_path / "reports"), out)
    assert json.loads((tmp_path / "reports" / "run_summary.json").read_text())["num_kept_pairs"] == 12
    assert "| low |" in (tmp_path / "reports" / "confidence.md").read_text()
    assert pipeline.evaluate_process(spark, gold, cfg.with_method("answer_dpo"), length_scorer, "x")["not_applicable"]


def test_batch_scorer(spark):
    rows = [("q", "p", "1", 0, "", ["a", "bb"], "1"), ("q", "p", "1", 1, "", [], "2")]
    t = spark.createDataFrame(rows, "id string, prompt string, answer string, trace_id int, reasoning string, steps array<string>, final_answer string")
    out = score_traces_in_batches(t, lambda: lambda batches: (b["prefix"].str.len().astype(float) for b in batches))
    assert {r.trace_id: (r.step_scores, r.final_correct) for r in out.collect()} == {0: ([1.0, 4.0], True), 1: ([], False)}


def test_process_templates(spark):
    rows = S.process_rows(spark, 200, 5).collect()
    assert rows == S.process_rows(spark, 200, 5).collect() and {r.gold_earliest_error_step for r in rows} == {0, 1, 2, 3}
    for r in rows:
        same = [a == b for a, b in zip(r.correct_steps, r.incorrect_steps)]
        assert len(r.correct_steps) == len(r.incorrect_steps) and same.index(False) == r.gold_earliest_error_step
        assert r.correct_steps[-1] == f"The answer is {r.answer}." and r.incorrect_steps[-1] == f"The answer is {r.incorrect_final_answer}." and r.answer != r.incorrect_final_answer
        for left, right in re.findall(r"((?:\d+ [-+*/] )+\d+) = (\d+)", " ".join(r.correct_steps)):
            assert eval(left) == int(right), left  # noqa: S307 - digits and signs
    assert len({re.sub(r"\d+", "", r.prompt) for r in rows}) >= 5


def test_prompt_files(spark, tmp_path):
    """Prompts are drawn by line with the seeds of their kind; evaluation falls back to the training file."""
    lines = [json.dumps({"id": f"p{i}", "prompt": "q" * (1 + i % 7), "answer": str(i)}) for i in range(300)]
    (tmp_path / "train.jsonl").write_text("\n".join(lines))
    cfg = from_dict({"paths": {"prompt_file": str(tmp_path / "train.jsonl")}, "data": {"max_train_prompts": 20, "max_eval_prompts": 30, "prompt_sampling_seed": 8}})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for which, limit, seed in (("train", 20, 8), ("eval", 30, 9)):
            got = S.load_prompts(spark, cfg, which)
            assert sorted(r.id for r in got.collect()) == sorted(f"p{i}" for i in random.Random(seed).sample(range(300), limit)) and "ord" not in got.columns
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert S.load_prompts(spark, from_dict({"paths": {"prompt_file": str(tmp_path / "train.jsonl")}})).count() == 300
    with pytest.raises(KeyError):
        S.load_prompts(spark, cfg, "other")


def test_data_preparation(spark, tmp_path):
    source = spark.range(50).selectExpr("id AS ord", "concat('question ', id) AS question", "concat('so #### ', id) AS answer")
    paths = {k: str(tmp_path / k) for k in ("prompt_file", "eval_prompt_file", "process_ground_truth_file")}
    cfg = from_dict({"paths": paths, "data": {"max_train_prompts": 5, "max_eval_prompts": 4, "max_process_examples": 6, "prompt_sampling_seed": 1}})
    S.prepare_data(spark, cfg, source, source)
    assert sorted(int(r.answer) for r in read_jsonl(spark, paths["prompt_file"], "prompt").collect()) == sorted(random.Random(1).sample(range(50), 5))
    assert sorted(int(r.answer) for r in read_jsonl(spark, paths["eval_prompt_file"], "prompt").collect()) == sorted(random.Random(2).sample(range(50), 4))
    gold = read_jsonl(spark, paths["process_ground_truth_file"], "gold")
    assert sorted(r.prompt for r in gold.collect()) == sorted(r.prompt for r in S.process_rows(spark, 6, 3).collect())
    with pytest.raises(ValueError, match="max_train_prompts"):
        S.prepare_data(spark, RunConfig(), source, source)


def test_yaml_of_a_whole_run(tmp_path):
    """Flat thresholds, sections about models and names that nothing here reads are taken as they are."""
    text = """
seed: 7
dtype: bf16
device: {policy: cuda, verifier: cuda}
paths: {prompt_file: in.jsonl, output_dir: out, traces_file: out/traces.jsonl}
resume: {use_existing_pairs: true}
policy: {model_name: some/model, num_return_sequences: 4}
verifier: {mode: process_reward_model, model_name: some/model, prm_step_token: "<s>"}
pair: {pair_mode: semi_purified, window_H: 3, semi_purified_min_confidence: 0.7, semi_purified_min_local_gap: 0.3, semi_purified_both_wrong_min_drop_advantage: 0.2}
confidence: {tau_margin: 0.1}
training: {model_name: some/model, beta: 0.2, lambda_ref: 0.05, lora_r: 16}
evaluation: {batch_size: 4}
"""
    (tmp_path / "run.yaml").write_text(text)
    cfg = load_config(str(tmp_path / "run.yaml"))
    assert (cfg.seed, cfg.pair.window_H, cfg.pair.semi_purified_min_confidence, cfg.pair.both_wrong.min_drop_advantage, cfg.pair.both_wrong.min_confidence) == (7, 3, 0.7, 0.2, 0.88)
    assert cfg.training.lambda_ref == 0.05 and cfg.training.other["lora_r"] == 16 and cfg.models["policy"]["num_return_sequences"] == 4
    assert cfg.verifier.prm_step_token == "<s>" and cfg.paths.other == {"traces_file": "out/traces.jsonl"} and cfg.resume.use_existing_pairs
    for wrong in ({"pair": {"windowH": 2}}, {"verifier": {"mode": "none"}}, {"unheard": 1}):
        with pytest.raises(ValueError):
            from_dict(wrong)


def test_generated_traces(spark):
    prompts = spark.createDataFrame([("a", "one", "3"), ("b", "two", "4")], "id string, prompt string, answer string")
    make = lambda: lambda batch, n: [[f"First {p}.\nSo it is {i}.\nThe answer is {i + 3}." for i in range(n)] for p in batch]
    got = sorted(generate_traces(prompts, 2, make).collect(), key=lambda r: (r.id, r.trace_id))
    assert [(r.id, r.trace_id, r.final_answer) for r in got] == [("a", 0, "3"), ("a", 1, "4"), ("b", 0, "3"), ("b", 1, "4")]
    assert got[2].steps == ["First two.", "So it is 0.", "The answer is 3."] and got[2].answer == "4"


def test_resume_and_order(spark, sf_dir, tmp_path):
    traces, cfg, out = Q.scored_traces(spark, sf_dir), Q.BASE, str(tmp_path / "run")
    first = pipeline.run_pairs(spark, traces, cfg, out)
    ranked = sorted(P.training_order(P.pairs(first.decisions)).collect(), key=lambda r: r.training_rank)
    ordered = [(r.confidence, r.id, r.a_ord, r.b_ord) for r in ranked]
    assert [r.training_rank for r in ranked] == list(range(1, len(ranked) + 1))
    assert ordered == sorted(ordered, key=lambda r: (-r[0], *r[1:])) and len(ordered) > 100
    stamps = lambda: {s: os.path.getmtime(f"{out}/{s}/_SUCCESS") for s in pipeline.STAGES}
    before = stamps()
    pipeline.run_pairs(spark, traces, cfg, out, resume_from="scored")
    assert {s for s, t in stamps().items() if t == before[s]} == {"scored"}
    before = stamps()
    again = pipeline.run_pairs(spark, traces.limit(0), dataclasses.replace(cfg, resume=ResumeConfig(use_existing_scored=True, use_existing_pairs=True)), out)
    assert stamps() == before and again.summary == first.summary


def test_median(spark):
    own = random.Random(3)
    for values in ([], [0.5], [0.0, 1.0], [own.random() for _ in range(501)], [0.25] * 300 + [own.random() for _ in range(100)], [1.0, 1.0, 0.9999999, 0.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        want = sorted(values)
        want = (want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2 if want else None
        assert R.median(df, df["v"]).first()[0] == want


def test_command_line(spark, sf_dir, tmp_path):
    traces = Q.scored_traces(spark, sf_dir).selectExpr("CAST(id AS STRING) AS id", "'p' AS prompt", "'1' AS answer", "trace_id", "'r' AS reasoning", "steps", "'1' AS final_answer", "step_scores", "final_correct")
    write_jsonl(traces, str(tmp_path / "traces"))
    (tmp_path / "run.json").write_text(json.dumps({"pair": {"pair_mode": "correctness_priority"}}))
    main(["pairs", "--config", str(tmp_path / "run.json"), "--traces", str(tmp_path / "traces"), "--out", str(tmp_path / "out"), "--reports", str(tmp_path / "reports")])
    text = {x: (tmp_path / "reports" / x).read_text() for x in ("diagnosis.md", "orientation_audit.md")}
    assert "- pair_mode: correctness_priority" in text["diagnosis.md"] and "kept_mixed_correctness" in text["diagnosis.md"]
    assert [x[3:] for x in text["orientation_audit.md"].splitlines() if x.startswith("## ")] == list(R.SECTIONS)
    assert "No examples." in text["orientation_audit.md"] and text["orientation_audit.md"].count("- status: kept") >= 4


def test_optional_modules(tmp_path, monkeypatch):
    """What is not there is left out; what is there and broken raises."""
    import __spark_entry__ as entry

    (tmp_path / "broken_part").mkdir()
    (tmp_path / "broken_part" / "__init__.py").write_text("")
    (tmp_path / "broken_part" / "inner.py").write_text("import a_module_that_is_not_there")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert entry._optional("broken_part.missing") is None and entry._optional("no_such_part.inner") is None and entry._optional("no_such_part") is None
    with pytest.raises(ModuleNotFoundError, match="a_module_that_is_not_there"):
        entry._optional("broken_part.inner")
