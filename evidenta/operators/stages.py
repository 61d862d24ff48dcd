"""Stages of a run: a runner that stops at the first failure, its audit rows, and checks of settings."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

AUDIT = "job_id string, stage string, status string, error string, started_at timestamp, ended_at timestamp"


def run(spark: SparkSession, job: str, stages: list[tuple[str, Callable[[], object]]], audit: str | None = None) -> DataFrame:
    """Run stages in order until one fails (C1); a row for each that began, appended to the table at `audit`.

    The rows say done or error; the error itself isn't raised, so that a caller can poll the rows.
    """
    rows = []
    for name, work in stages:
        began, error = datetime.now(timezone.utc), None
        try:
            work()
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
        rows.append((job, name, "error" if error else "done", error, began, datetime.now(timezone.utc)))
        if error:
            break
    out = spark.createDataFrame(rows, AUDIT)
    if audit:
        out.write.mode("append").parquet(audit)
    return out


def preflight(settings: dict, needed: dict[str, type]) -> list[str]:
    """What is wrong with the settings, by dotted name: missing, or of another type (C4)."""
    wrong = []
    for name, kind in needed.items():
        value = settings
        for part in name.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value is None:
            wrong.append(f"{name} is missing")
        elif not isinstance(value, kind):
            wrong.append(f"{name} is no {kind.__name__}")
    return wrong


def has_model(models: list[str], wanted: str) -> bool:
    """Whether a model is there under its name, its latest tag, or any tag of the same stem (P20)."""
    return wanted in models or f"{wanted}:latest" in models or any(m.split(":")[0] == wanted.split(":")[0] for m in models)
