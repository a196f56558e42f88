"""Command line: ``python -m tracepairs pairs --config run.yaml --traces scored.jsonl --out folder``.

Models are functions of the caller, so generation and training have no command; final evaluation takes a model's outputs.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tracepairs.config import load_config
from tracepairs.operators.sampling import load_prompts, prepare_data, with_line_ordinals
from tracepairs.operators.scoring import scorer
from tracepairs.plans import pipeline, render
from tracepairs.sources.datasets import load_dataset
from tracepairs.sources.jsonl import read_jsonl, write_json, write_jsonl


def _pairs(spark: SparkSession, args: argparse.Namespace) -> None:
    """Decisions, pairs and reports from traces, scored by ``--scorer`` if that is given."""
    cfg = load_config(args.config)
    traces = with_line_ordinals(read_jsonl(spark, args.traces, "trace" if args.scorer else "scored_trace"))
    gold = read_jsonl(spark, args.gold, "gold") if args.gold else None
    result = pipeline.run_pairs(spark, traces, cfg, args.out, scorer=scorer(args.scorer) if args.scorer else None, gold=gold, resume_from=args.resume_from)
    pipeline.write_reports(result, cfg, args.reports or args.out)


def _process(spark: SparkSession, args: argparse.Namespace) -> None:
    """Earliest-error evaluation: of the traces in gold rows, scored by ``--scorer``, or of the pairs that a run wrote to ``--pairs``."""
    cfg, gold = load_config(args.config), read_jsonl(spark, args.gold, "gold")
    if args.pairs:
        found = pipeline.evaluate_process_of_pairs(gold, cfg, spark.read.parquet(args.pairs))
    elif args.scorer and args.out:
        found = pipeline.evaluate_process(spark, gold, cfg, scorer(args.scorer), args.out)
    else:
        raise ValueError("give --pairs, or --scorer and --out")
    write_json(found, args.report)


def _prompts(spark: SparkSession, args: argparse.Namespace) -> None:
    """The sampled prompts of a configuration."""
    write_jsonl(load_prompts(spark, load_config(args.config), args.which), args.out)


def _prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    """Prompt and process files from (question, answer) lines, or from the configuration's data set below ``--datasets``."""
    cfg, columns = load_config(args.config), "question string, answer string"
    if args.datasets:
        if not cfg.data.dataset_name:
            raise ValueError("the configuration names no data set")
        read = lambda split: load_dataset(spark, args.datasets, cfg.data.dataset_name, cfg.data.dataset_config_name, split, columns)
    elif args.train and args.test:
        read = lambda split: with_line_ordinals(spark.read.schema(columns).json(getattr(args, split)))
    else:
        raise ValueError("give --datasets, or --train and --test")
    prepare_data(spark, cfg, read("train"), read("test"))


def _final(spark: SparkSession, args: argparse.Namespace) -> None:
    """Final evaluation: grades the outputs of a model on the evaluation prompts."""
    cfg = load_config(args.config)
    report = pipeline.evaluate_final(spark, cfg, load_prompts(spark, cfg, "eval"), read_jsonl(spark, args.predictions, "prediction"), args.out, model_name=args.model_name)
    write_json(report, args.report or cfg.paths.final_eval_file or f"{args.out}/final_eval.json")


def _steps(spark: SparkSession, args: argparse.Namespace) -> None:
    """Figures by optimizer step, and a summary of each run, from the metrics of its batches."""
    runs = pipeline.training_report(spark, load_config(args.config), read_jsonl(spark, args.metrics, "metric"), args.out)
    write_json({"runs": runs}, f"{args.out}/training.json")
    with open(f"{args.out}/training.md", "w", encoding="utf-8") as f:
        f.write(render.training_report(runs))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tracepairs")
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, needed: list[str], optional: list[str]) -> None:
        p = commands.add_parser(name, help=run.__doc__)
        for x in ["config", *needed]:
            p.add_argument(f"--{x}", required=True)
        for x in optional:
            p.add_argument(f"--{x}")
        p.set_defaults(run=run)

    command("pairs", _pairs, ["traces", "out"], ["scorer", "gold", "resume-from", "reports"])
    command("process", _process, ["gold", "report"], ["scorer", "out", "pairs"])
    command("prompts", _prompts, ["out", "which"], [])
    command("prepare", _prepare, [], ["train", "test", "datasets"])
    command("final", _final, ["predictions", "out"], ["report", "model-name"])
    command("steps", _steps, ["metrics", "out"], [])
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
