"""Parameters of a run as frozen dataclasses; unknown names and values outside the fixed vocabularies raise."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

PAIR_MODES = ("current_utility", "correctness_priority", "strict_purified", "semi_purified")
VERIFIERS = ("judge_token", "mean_logprob", "process_reward_model")
METHODS = ("answer_dpo", "step_dpo", "confidence_filter_only", "confidence_weighted_step_dpo")


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class ClassGate:
    """Least values that keep a pair of equally correct traces."""

    min_confidence: float
    min_utility_margin: float
    min_local_gap: float
    min_support_gap: float
    min_drop_advantage: float | None = None


@dataclass(frozen=True)
class PairConfig:
    pair_mode: str = "current_utility"
    window_H: int = 2
    alpha_local: float = 0.8
    tau_pair: float = 0.1
    min_weight: float = 0.2
    max_pairs_per_prompt: int = 12
    min_divergent_chars: int = 24
    max_near_identical_similarity: float = 0.94
    semi_purified_min_confidence: float = 0.82
    both_correct: ClassGate = ClassGate(0.76, 0.25, 0.20, 0.05)
    both_wrong: ClassGate = ClassGate(0.88, 0.45, 0.35, 0.10, 0.15)

    def __post_init__(self):
        _one_of(self.pair_mode, PAIR_MODES, "pair_mode")


@dataclass(frozen=True)
class ConfidenceConfig:
    tau_margin: float = 0.05
    scale_margin: float = 0.10
    scale_drop: float = 0.25
    gamma_margin: float = 0.40
    gamma_sharp: float = 0.20
    gamma_agree: float = 0.20
    gamma_out: float = 0.20
    use_margin: bool = True
    use_sharp: bool = True
    use_agree: bool = True
    use_out: bool = True
    low_threshold: float = 0.33
    high_threshold: float = 0.66


@dataclass(frozen=True)
class MethodConfig:
    name: str = "confidence_weighted_step_dpo"
    confidence_threshold: float = 0.0

    def __post_init__(self):
        _one_of(self.name, METHODS, "method")


@dataclass(frozen=True)
class DataConfig:
    max_train_prompts: int | None = None
    max_eval_prompts: int | None = None
    max_process_examples: int | None = None
    prompt_sampling_seed: int = 42
    append_step_by_step_suffix: bool = True
    dataset_name: str | None = None
    dataset_config_name: str | None = None


@dataclass(frozen=True)
class DiagnosticsConfig:
    num_audit_samples_per_bucket: int = 8
    pair_audit_seed: int = 42
    histogram_bins: int = 10
    num_orientation_audit_samples: int = 4


@dataclass(frozen=True)
class PathsConfig:
    """Files of a run; names that nothing here reads are kept in ``other``."""

    prompt_file: str | None = None
    eval_prompt_file: str | None = None
    process_ground_truth_file: str | None = None
    output_dir: str | None = None
    checkpoint_dir: str | None = None
    final_eval_file: str | None = None
    other: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ResumeConfig:
    """Which stages take up the tables of an earlier run."""

    use_existing_traces: bool = False
    use_existing_scored: bool = False
    use_existing_pairs: bool = False
    use_existing_checkpoint: bool = False
    use_existing_final_eval: bool = False
    use_existing_process_eval: bool = False


@dataclass(frozen=True)
class VerifierConfig:
    # The default texts that a process reward model was trained with.
    mode: str = "judge_token"
    prompt_template: str = ""
    prm_system_prompt: str = "Please reason step by step, and put your final answer within \\boxed{}."
    prm_step_token: str = "<extra_0>"
    prm_positive_label_index: int = 1
    other: dict = field(default_factory=dict)

    def __post_init__(self):
        _one_of(self.mode, VERIFIERS, "verifier mode")


@dataclass(frozen=True)
class TrainingConfig:
    """What batches, loss and step figures need; the rest, which only a trainer reads, is kept in ``other``."""

    model_name: str | None = None
    beta: float = 0.1
    lambda_ref: float = 0.0
    batch_size: int = 1
    grad_accum_steps: int = 8
    num_epochs: int = 1
    lr: float = 2e-5
    warmup_ratio: float = 0.03
    max_length: int = 2048
    other: dict = field(default_factory=dict)


@dataclass(frozen=True)
class RunConfig:
    pair: PairConfig = field(default_factory=PairConfig)
    confidence: ConfidenceConfig = field(default_factory=ConfidenceConfig)
    method: MethodConfig = field(default_factory=MethodConfig)
    data: DataConfig = field(default_factory=DataConfig)
    diagnostics: DiagnosticsConfig = field(default_factory=DiagnosticsConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    paths: PathsConfig = field(default_factory=PathsConfig)
    resume: ResumeConfig = field(default_factory=ResumeConfig)
    verifier: VerifierConfig = field(default_factory=VerifierConfig)
    models: dict = field(default_factory=dict)
    seed: int = 42

    @property
    def pair_type(self) -> str:
        return "answer_level" if self.method.name == "answer_dpo" else "local_step"

    @property
    def threshold(self) -> float:
        """Least confidence that the method keeps; methods with uniform weights do not filter."""
        if self.method.name in ("confidence_filter_only", "confidence_weighted_step_dpo"):
            return max(self.method.confidence_threshold, self.pair.min_weight)
        return 0.0

    def with_method(self, name: str) -> RunConfig:
        return dataclasses.replace(self, method=dataclasses.replace(self.method, name=name))

    def with_mode(self, pair_mode: str) -> RunConfig:
        return dataclasses.replace(self, pair=dataclasses.replace(self.pair, pair_mode=pair_mode))


#: Sections about models, which are kept as they are.
_MODEL_SECTIONS = ("dtype", "device", "policy", "evaluation")
_GATE = "semi_purified_"


def _gates(pair: dict) -> dict:
    """``semi_purified_both_correct_min_confidence`` and the like as fields of the gates; the thresholds that the classes
    have of their own replace the general ones of margin and gap."""
    out = {}
    for name, value in pair.items():
        of = next((g for g in ("both_correct", "both_wrong") if name.startswith(f"{_GATE}{g}_")), None)
        if of:
            out[of] = {**out.get(of, {}), name.removeprefix(f"{_GATE}{of}_"): value}
        elif name in ("both_correct", "both_wrong"):
            out[name] = {**out.get(name, {}), **value}
        elif name not in (f"{_GATE}min_utility_margin", f"{_GATE}min_local_gap"):
            out[name] = value
    return out


def from_dict(values: dict, kind: type = RunConfig):
    """A dataclass from nested plain values."""
    parts = {f.name: f for f in dataclasses.fields(kind)}
    values = dict(values)
    if kind is RunConfig:
        models = {k: values.pop(k) for k in _MODEL_SECTIONS if k in values}
        values["models"] = {**models, **values.get("models", {})}
        values["pair"] = _gates(values.get("pair") or {})
    unknown = {k: values.pop(k) for k in list(values) if k not in parts}
    if unknown and "other" not in parts:
        raise ValueError(f"unknown {kind.__name__} fields: {', '.join(sorted(unknown))}")
    base = kind() if kind is not ClassGate else None
    out = {"other": {**unknown, **values.pop("other", {})}} if "other" in parts else {}
    for name, value in values.items():
        own = getattr(base, name, None) if base is not None else None
        if isinstance(own, float) and isinstance(value, str):
            value = float(value)  # YAML takes 2e-5 for a text
        out[name] = from_dict({**dataclasses.asdict(own), **value} if isinstance(own, ClassGate) else value or {}, type(own)) if dataclasses.is_dataclass(own) else value
    return kind(**out)


def load_config(path: str) -> RunConfig:
    """From a YAML or JSON file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return from_dict(json.loads(text))
    import yaml

    return from_dict(yaml.safe_load(text) or {})
