"""Preparing, scoring and reporting on code-generation data with Spark."""

from codegauge.functions.compare import as_set, is_close, is_correct, is_float
from codegauge.functions.execution import run_name, throughput
from codegauge.functions.extract import extract_code
from codegauge.functions.outcome import parse_outcome, pass_rate, reward
from codegauge.functions.scripts import rewrite
from codegauge.functions.text import completion_text
from codegauge.operators.checkpoints import datasets_to_evaluate, latest_run, pending, run_status
from codegauge.operators.execute import execute_scripts, execute_with_fallback, merge_fallback
from codegauge.operators.metrics import (
    batch_throughput,
    dataset_metrics,
    execution_telemetry,
    model_change,
    periodic_metrics,
    request_summary,
    skipped_examples,
    training_verification,
    verify_per_task,
    verify_summary,
)
from codegauge.operators.prepare import (
    prepare_benchmark_a,
    prepare_benchmark_b,
    prepare_training,
    sample_rows,
)
from codegauge.operators.scoring import (
    add_rewards,
    apply_rewards,
    build_scripts,
    classify_execution,
    score_rewards,
    score_tasks,
)
from codegauge.operators.triage import resolve_dependencies, triage
from codegauge.session import configure
from codegauge.streaming.scoring import score_stream, windowed_metrics

__all__ = [name for name in dir() if not name.startswith("_")]
