"""The whole run over stage tables: scored traces, decisions, pairs, reports, earliest-error evaluation."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracepairs.config import RunConfig
from tracepairs.operators import pairs as P
from tracepairs.operators import process_eval as E
from tracepairs.operators import reports as R
from tracepairs.operators import sampling as S
from tracepairs.operators import training as B
from tracepairs.operators.scoring import ColumnScorer, final_accuracy, grade, score_traces
from tracepairs.plans import render
from tracepairs.sources.jsonl import reusable, stage_table, write_json
from tracepairs.sources.stages import staging

STAGES = ["scored", "decisions", "pairs"]


@dataclass
class RunResult:
    decisions: DataFrame
    pairs: DataFrame
    summary: dict


def _row(df: DataFrame) -> dict:
    """The only row of an aggregate."""
    return df.first().asDict(recursive=True)


def _rows(df: DataFrame) -> list[dict]:
    """The few rows of a grouped report."""
    return [r.asDict(recursive=True) for r in df.collect()]


def run_pairs(spark: SparkSession, traces: DataFrame, cfg: RunConfig, out_dir: str, *, scorer: ColumnScorer | None = None, gold: DataFrame | None = None, resume_from: str | None = None) -> RunResult:
    """Builds and writes ``scored``, ``decisions`` and ``pairs`` under ``out_dir``; later stages read the tables.

    ``scorer`` is needed for traces without ``step_scores``. Tables of stages up to ``resume_from`` are reused if there, and
    those that the configuration's flags name (decisions belong to the pairs).
    """
    flags = {"scored": cfg.resume.use_existing_scored, "decisions": cfg.resume.use_existing_pairs, "pairs": cfg.resume.use_existing_pairs}
    again = {s: reusable(s, STAGES, resume_from=resume_from, flag=flags[s]) for s in STAGES}
    scored = stage_table(spark, f"{out_dir}/scored", lambda: score_traces(traces, scorer) if scorer else traces, reuse=again["scored"])
    decided = stage_table(spark, f"{out_dir}/decisions", lambda: P.decisions(scored, cfg), reuse=again["decisions"])
    with staging(spark):
        kept = stage_table(spark, f"{out_dir}/pairs", lambda: P.training_order(P.pairs(decided)), reuse=again["pairs"])
    summary = {
        "method_name": cfg.method.name,
        "pair_type": cfg.pair_type,
        "pair_mode": cfg.pair.pair_mode if cfg.pair_type == "local_step" else "answer_level",
        "lambda_ref": cfg.training.lambda_ref,
        "purity": _row(R.purity_report(decided, cfg)) | _row(R.average_steps(scored)),
        "status_counts": {r["value"]: r["n"] for r in _rows(R.value_counts(decided, "final_status").orderBy("value"))},
        "orientation_counts": {r["value"]: r["n"] for r in _rows(R.orientation_counts(decided).orderBy("value"))},
        "analysis": _row(R.analysis(decided, cfg)),
        "buckets": _rows(R.bucket_summary(kept, cfg, gold)),
        "histogram": _rows(R.histogram(kept, R.pair_confidence(kept), cfg.diagnostics.histogram_bins).orderBy("bin")),
    }
    return RunResult(decided, kept, summary)


def _not_applicable(gold: DataFrame) -> dict:
    return {"not_applicable": True, "reason": "answer-level pairs have no local boundary", "num_evaluated_examples": gold.count()}


def _process_report(judged: DataFrame, scope: str) -> dict:
    return {
        "scope": scope,
        "metrics": _row(E.metrics(judged)),
        "confusion": _rows(E.confusion(judged).orderBy("gold", F.col("pred").asc_nulls_first())),
        "failures": _rows(E.failures(judged)),
    }


def evaluate_process_of_pairs(gold: DataFrame, cfg: RunConfig, kept: DataFrame) -> dict:
    """Earliest-error evaluation of the pairs that a run kept, on gold rows of which only id and position are needed."""
    return _not_applicable(gold) if cfg.pair_type == "answer_level" else _process_report(E.judge(E.predict(kept), gold), "pairs of a run")


def evaluate_process(spark: SparkSession, gold: DataFrame, cfg: RunConfig, scorer: ColumnScorer, out_dir: str) -> dict:
    """Earliest-error evaluation on gold rows with both traces, which are scored and paired here; not defined for answer-level
    pairs."""
    if cfg.pair_type == "answer_level":
        return _not_applicable(gold)
    result = run_pairs(spark, E.expand_gold(gold), cfg, out_dir, scorer=scorer, gold=gold)
    return _process_report(E.judge(E.predict(result.pairs), gold), "traces of the gold rows") | {"pair_build": result.summary}


def resolve_model_name(spark: SparkSession, cfg: RunConfig, name: str | None = None) -> dict:
    """Which model a final evaluation is of: ``name``, else the final checkpoint if there, else the base model; and whether that
    is a folder with an adapter."""
    there = lambda path: (at := spark._jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    final = f"{cfg.paths.checkpoint_dir.rstrip('/')}/final" if cfg.paths.checkpoint_dir else None
    chosen = name or (final if final and there(final) else cfg.training.model_name)
    adapter = chosen is not None and there(f"{chosen}/adapter_config.json")
    return {"model_name": chosen, "base_model_name": cfg.training.model_name, "adapter_path": chosen if adapter else None, "adapter_loaded": adapter}


def evaluate_final(spark: SparkSession, cfg: RunConfig, prompts: DataFrame, predictions: DataFrame, out_dir: str, *, model_name: str | None = None) -> dict:
    """Grades ``predictions`` (id, output) of the evaluation prompts: writes the graded table (id, pred, gold, correct) under
    ``out_dir`` and gives the report. A prompt without a prediction is wrong; of repeated ones the first text counts; others are left out."""
    outputs = predictions.groupBy("id").agg(F.min("output").alias("output"))
    rows = prompts.select("id", "answer").join(outputs, "id", "left")
    graded = stage_table(spark, f"{out_dir}/graded", lambda: grade(rows).select("id", "pred", F.col("answer").alias("gold"), "correct", F.col("output").isNull().alias("missing")))
    found = _row(final_accuracy(graded))
    return resolve_model_name(spark, cfg, model_name) | {"accuracy": found["final_accuracy"], "num_correct": found["num_correct"], "num_examples": found["num_examples"], "num_missing": graded.where("missing").count()}


def training_report(spark: SparkSession, cfg: RunConfig, metrics: DataFrame, out_dir: str) -> list[dict]:
    """Writes the figures by optimizer step of all runs under ``out_dir`` and gives a summary of each run, by name; none without
    batches."""
    stage_table(spark, f"{out_dir}/steps", lambda: B.optimizer_steps(metrics, cfg))
    base = {"method_name": cfg.method.name, "pair_type": cfg.pair_type, "num_epochs": cfg.training.num_epochs, "base_model_name": cfg.training.model_name}
    return [r | base for r in _rows(B.training_summary(metrics, cfg).orderBy("run"))]


def run_summary(result: RunResult, process: dict | None = None, final: dict | None = None) -> dict:
    """The figures of all stages in one flat report."""
    purity = result.summary["purity"]
    n = max(1, purity["num_kept_pairs"])
    out = {k: result.summary[k] for k in ("method_name", "pair_type", "pair_mode", "lambda_ref")}
    out |= purity | result.summary["analysis"]
    out |= {f"kept_fraction_{k}": purity[k] / n for k in ("both_correct", "both_wrong")}
    out["kept_fraction_same_correctness"] = out["kept_fraction_both_correct"] + out["kept_fraction_both_wrong"]
    out["process_scope"] = (process or {}).get("scope")
    out |= {f"process_{k}": v for k, v in (process or {}).get("metrics", {}).items()} | {f"final_{k}": v for k, v in (final or {}).items()}
    return out


def write_reports(result: RunResult, cfg: RunConfig, out_dir: str, process: dict | None = None, final: dict | None = None) -> None:
    """JSON and Markdown reports; every table in them is an aggregate or a bounded sample."""
    os.makedirs(out_dir, exist_ok=True)
    whole = run_summary(result, process, final)
    write_json(whole, f"{out_dir}/run_summary.json")
    write_json(result.summary, f"{out_dir}/pair_report.json")
    d = cfg.diagnostics
    with staging(result.pairs.sparkSession):
        audits = S.audit_sample(result.pairs, "confidence_bucket", ["low", "medium", "high"], [F.col("training_rank")], d.num_audit_samples_per_bucket, d.pair_audit_seed)
        oriented = S.audit_sample(R.in_sections(result.decisions), "section", list(R.SECTIONS), P.decision_order(result.decisions), d.num_orientation_audit_samples, d.pair_audit_seed)
        drawn, turned = _rows(audits.orderBy("confidence_bucket", "place")), _rows(oriented.orderBy("section", "place"))
    texts = {
        "confidence.md": render.confidence_report(result.summary["analysis"], result.summary["buckets"], result.summary["histogram"]),
        "pair_audit.md": render.pair_audit("Kept pairs by confidence", drawn),
        "orientation_audit.md": render.orientation_audit(list(R.SECTIONS), turned),
        "diagnosis.md": render.diagnosis_summary(whole, result.summary["status_counts"]),
    }
    if process and "metrics" in process:
        texts["process_failures.md"] = render.process_failures(process["metrics"], process["failures"], process.get("pair_build", {}).get("buckets"))
    for name, text in texts.items():
        with open(f"{out_dir}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
