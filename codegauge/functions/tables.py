"""Table functions for SQL text: ``register`` makes them known to a session.

``triage_scripts(TABLE (SELECT id, script …))`` gives the engine verdict of each script,
``prompt_rewards(TABLE (SELECT prompt_id, sample_id, stdout, success …) PARTITION BY
prompt_id)`` the rewards of each prompt's completions, with the prompt's mean and the
advantage over it.  Columns are found by these names; ids come back as text.  Rows arrive
as Arrow batches, and a prompt's rewards (numbers and ids, no texts) are held together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codegauge import fixed_values as V
from codegauge.operators.triage import describe_script

TRIAGE = "id string, parse_ok boolean, modules array<string>, is_compatible boolean, reason string"
REWARDS = "prompt_id string, sample_id string, reward double, prompt_mean double, advantage double"

_ARROW_TRIAGE = pa.schema([("id", pa.string()), ("parse_ok", pa.bool_()), ("modules", pa.list_(pa.string())), ("is_compatible", pa.bool_()), ("reason", pa.string())])
_ARROW_REWARDS = pa.schema([("prompt_id", pa.string()), ("sample_id", pa.string()), *[(n, pa.float64()) for n in ("reward", "prompt_mean", "advantage")]])


def verdict(script: str | None) -> dict:
    """What ``operators.triage.triage`` says of one script."""
    facts = describe_script(script)
    if facts is None:
        return {"parse_ok": None, "modules": [], "is_compatible": True, "reason": None}
    imported = sorted({m for node in facts["nodes"] for m in node["modules"]})
    reason = None
    if any(len(line) > V.FAST_ENGINE_MAX_LINE for line in script.split("\n")):
        reason = V.LONG_LINE_REASON
    else:
        for node in facts["nodes"]:
            outside = sorted(set(node["modules"]) - set(V.FAST_ENGINE_MODULES))
            if node["kind"] != "import":
                reason = f"Unsupported feature: {node['kind']} declaration"
            elif outside:
                reason = "Unsupported module(s): " + ", ".join(outside)
            if reason:
                break
    return {"parse_ok": facts["parse_ok"], "modules": imported, "is_compatible": reason is None, "reason": reason}


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def reward_of(stdout: str | None, success: bool | None) -> float:
    """The share of true results in the JSON list a successful run printed last, else 0."""
    if not success or not (stdout or "").strip():
        return 0.0
    try:
        results = json.loads(stdout.strip().split("\n")[-1], parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return 0.0
    if not isinstance(results, list) or not results:
        return 0.0
    return sum(map(bool, results)) / len(results)


def _texts(column: pa.Array) -> list[str | None]:
    return column.cast(pa.string()).to_pylist()


@F.arrow_udtf(returnType=TRIAGE)
class TriageScripts:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = [{"id": i, **verdict(s)} for i, s in zip(_texts(batch.column("id")), batch.column("script").to_pylist())]
        yield pa.Table.from_pylist(rows, _ARROW_TRIAGE)


@F.arrow_udtf(returnType=REWARDS)
class PromptRewards:
    """With ``PARTITION BY`` each prompt has an instance of its own."""

    def __init__(self):
        self.prompts: list[str | None] = []
        self.samples: list[str | None] = []
        self.rewards: list[float] = []

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        self.prompts += _texts(batch.column("prompt_id"))
        self.samples += _texts(batch.column("sample_id"))
        self.rewards += map(reward_of, batch.column("stdout").to_pylist(), batch.column("success").to_pylist())
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.rewards:
            # the sum of the sorted rewards does not depend on the order of the rows
            mean = sum(sorted(self.rewards)) / len(self.rewards)
            columns = [self.prompts, self.samples, self.rewards, [mean] * len(self.rewards), [r - mean for r in self.rewards]]
            yield pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW_REWARDS)], schema=_ARROW_REWARDS)


def register(spark: SparkSession) -> None:
    """Make the table functions callable from SQL text."""
    spark.udtf.register("triage_scripts", TriageScripts)
    spark.udtf.register("prompt_rewards", PromptRewards)
