"""Markdown from small, already aggregated reports (driver side)."""

from __future__ import annotations


def _cell(value) -> str:
    return "n/a" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def table(rows: list[dict], columns: list[str] | None = None) -> str:
    columns = columns or (list(rows[0]) if rows else [])
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(r.get(c)) for c in columns) + " |" for r in rows])


def confidence_report(analysis: dict, buckets: list[dict], bins: list[dict]) -> str:
    facts = "\n".join(f"- {name}: {_cell(value)}" for name, value in analysis.items())
    return f"# Confidence\n\n{facts}\n\n## Buckets\n\n{table(buckets)}\n\n## Histogram\n\n{table(bins)}\n"


def _pair(r: dict) -> str:
    steps = lambda name: "\n".join(f"    {s}" for s in r.get(name) or []) or "    (none)"
    return (
        f"- decision: {r.get('decision_id')}\n- status: {r.get('final_status')}\n- orientation: {_cell(r.get('orientation_reason'))}\n- confidence: {_cell(r.get('confidence'))}\n\n"
        f"Prefix:\n\n{steps('prefix_steps')}\n\nPreferred:\n\n{steps('preferred_steps')}\n\nDispreferred:\n\n{steps('dispreferred_steps')}"
    )


def pair_audit(title: str, rows: list[dict]) -> str:
    return "\n\n".join([f"# {title}", *[f"## {r.get('decision_id')}\n\n{_pair(r)}" for r in rows]]) + "\n"


def orientation_audit(sections: list[str], rows: list[dict]) -> str:
    """All sections in their order, also those without rows."""
    parts = ["# Orientation of pairs"]
    for title in sections:
        own = [_pair(r) for r in rows if r["section"] == title]
        parts += [f"## {title}", *(own or ["No examples."])]
    return "\n\n".join(parts) + "\n"


def process_failures(metrics: dict, failures: list[dict], buckets: list[dict] | None = None) -> str:
    facts = "\n".join(f"- {name}: {_cell(value)}" for name, value in metrics.items())
    by_confidence = f"## Confidence buckets\n\n{table(buckets, ['bucket', 'n', 'mean_confidence', 'process_boundary_accuracy'])}\n\n" if buckets else ""
    first = table(failures) if failures else "None."
    return f"# Earliest wrong step\n\n{facts}\n\n{by_confidence}## First failures\n\n{first}\n"


def training_report(runs: list[dict]) -> str:
    """A part for each run."""
    parts = [f"## {r['run']}\n\n" + "\n".join(f"- {k}: {_cell(v)}" for k, v in r.items() if k != "run") for r in runs]
    return "\n\n".join(["# Training", *(parts or ["No batches."])]) + "\n"


#: The figures of a run that tell how good its pairs are, by heading.
DIAGNOSIS = {
    "Run": ["method_name", "pair_type", "pair_mode", "lambda_ref", "num_pairs", "num_raw_pairs", "num_dropped_by_confidence", "mean_confidence"],
    "Pairs": [
        "fraction_strictly_instructional_pairs", "fraction_ambiguous_pairs", "kept_fraction_same_correctness", "kept_fraction_both_correct",
        "kept_fraction_both_wrong", "fraction_misoriented_mixed_correctness_pairs",
    ],
    "Downstream": ["final_final_accuracy", "process_earliest_error_exact", "process_earliest_error_near_miss", "process_coverage", "process_scope"],
}


def diagnosis_summary(summary: dict, status_counts: dict) -> str:
    """The run in one page; a heading of which nothing was measured is left out."""
    parts = ["# Diagnosis"]
    for heading, names in DIAGNOSIS.items():
        if any(summary.get(n) is not None for n in names):
            parts.append(f"## {heading}\n\n" + "\n".join(f"- {n}: {_cell(summary.get(n))}" for n in names))
    parts.append("## Outcomes\n\n" + table([{"outcome": k, "comparisons": v} for k, v in sorted(status_counts.items())], ["outcome", "comparisons"]))
    return "\n\n".join(parts) + "\n"
