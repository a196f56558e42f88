"""Record types as hand-written schemas; the first columns are those that every record must have."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_STEPS, _SCORES = T.ArrayType(_S), T.ArrayType(_D)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


PROMPT = _schema(id=_S, prompt=_S, answer=_S, reference_solution=_S, source_split=_S)
TRACE = _schema(id=_S, prompt=_S, answer=_S, trace_id=_I, reasoning=_S, steps=_STEPS, final_answer=_S)
SCORED_TRACE = _schema(**{f.name: f.dataType for f in TRACE}, step_scores=_SCORES, final_correct=_B)
GOLD = _schema(id=_S, gold_earliest_error_step=_I, prompt=_S, answer=_S, correct_steps=_STEPS, incorrect_steps=_STEPS, incorrect_final_answer=_S)

PREDICTION = _schema(id=_S, output=_S)
METRIC = _schema(run=_S, epoch=_I, batch=_I, loss=_D, dpo_term=_D, ref_pen=_D)

REQUIRED = {
    "prompt": ["id", "prompt", "answer"],
    "trace": [f.name for f in TRACE],
    "scored_trace": [f.name for f in SCORED_TRACE],
    "gold": ["id", "gold_earliest_error_step"],
    "prediction": ["id", "output"],
    "metric": ["run", "epoch", "batch", "loss"],
}
SCHEMAS = {"prompt": PROMPT, "trace": TRACE, "scored_trace": SCORED_TRACE, "gold": GOLD, "prediction": PREDICTION, "metric": METRIC}
