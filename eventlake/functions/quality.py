"""Quality gate: thresholds, rates and status, as plain functions and as SQL."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("HEALTHY", "WARNING", "FAILED")


@dataclass(frozen=True)
class Thresholds:
    """Percentages.  The pass rate must stay above its limits, the other rates below theirs."""

    pass_warn: float = 95.0
    pass_fail: float = 80.0
    quarantine_warn: float = 20.0
    quarantine_fail: float = 40.0
    late_warn: float = 10.0
    late_fail: float = 25.0

    def __post_init__(self):
        if not 0 <= self.pass_fail <= self.pass_warn <= 100:
            raise ValueError("pass limits must satisfy 0 <= fail <= warn <= 100")
        for name in ("quarantine", "late"):
            if not 0 <= getattr(self, f"{name}_warn") <= getattr(self, f"{name}_fail") <= 100:
                raise ValueError(f"{name} limits must satisfy 0 <= warn <= fail <= 100")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "EVENTLAKE_DQ_") -> Thresholds:
        env = os.environ if env is None else env
        given = {}
        for name in cls.__dataclass_fields__:
            raw = env.get(prefix + name.upper())
            if raw is not None:
                try:
                    given[name] = float(raw)
                except ValueError as error:
                    raise ValueError(f"{prefix}{name.upper()} must be numeric") from error
        return cls(**given)


def pass_status(rate: float, t: Thresholds) -> str:
    if not 0 <= rate <= 100:
        raise ValueError("a rate lies between 0 and 100")
    return STATUSES[(rate < t.pass_warn) + (rate < t.pass_fail)]


def rate_status(rate: float, warn: float, fail: float) -> str:
    if not 0 <= rate <= 100:
        raise ValueError("a rate lies between 0 and 100")
    return STATUSES[(rate >= warn) + (rate >= fail)]


@dataclass(frozen=True)
class Assessment:
    pass_rate: float
    quarantine_rate: float
    late_event_rate: float
    overall_status: str
    warnings: list[str] = field(default_factory=list)


def assess(counts: Mapping[str, int], t: Thresholds = Thresholds()) -> Assessment:
    """``counts``: input, valid, quarantined, late.  An empty batch is healthy."""
    n = counts["input"]
    share = lambda key, empty: 100.0 * counts[key] / n if n else empty
    rates = {"pass_rate": share("valid", 100.0), "quarantine_rate": share("quarantined", 0.0), "late_event_rate": share("late", 0.0)}
    status = {
        "pass_rate": pass_status(rates["pass_rate"], t),
        "quarantine_rate": rate_status(rates["quarantine_rate"], t.quarantine_warn, t.quarantine_fail),
        "late_event_rate": rate_status(rates["late_event_rate"], t.late_warn, t.late_fail),
    }
    worst = max(status.values(), key=STATUSES.index)
    return Assessment(**rates, overall_status=worst, warnings=[f"{k} {rates[k]:.2f}% is {s}" for k, s in status.items() if s != "HEALTHY"])


def status_columns(t: Thresholds = Thresholds()) -> dict[str, Column]:
    """The same over columns ``input``, ``valid``, ``quarantined``, ``late``; add them in order."""
    share = lambda key, empty: F.when(F.col("input") == 0, F.lit(empty)).otherwise(F.lit(100.0) * F.col(key) / F.col("input"))
    grade = lambda bad, worse: F.when(worse, 2).when(bad, 1).otherwise(0)
    p, q, late = F.col("pass_rate"), F.col("quarantine_rate"), F.col("late_event_rate")
    worst = F.greatest(grade(p < t.pass_warn, p < t.pass_fail), grade(q >= t.quarantine_warn, q >= t.quarantine_fail), grade(late >= t.late_warn, late >= t.late_fail))
    return {
        "pass_rate": share("valid", 100.0),
        "quarantine_rate": share("quarantined", 0.0),
        "late_event_rate": share("late", 0.0),
        "overall_status": F.element_at(F.array(*map(F.lit, STATUSES)), worst + 1),
    }


class QualityGateError(RuntimeError):
    """The batch failed the gate; its evidence is already stored."""


def enforce(a: Assessment, alert: Callable[[str], object] | None = None) -> bool:
    """Raises on FAILED.  Alerts on anything but HEALTHY; a failing alert never fails the run.  Returns whether an alert went out."""
    sent = False
    if a.overall_status != "HEALTHY" and alert is not None:
        try:
            alert("; ".join(a.warnings))
            sent = True
        except Exception:  # noqa: BLE001 - best effort by contract
            sent = False
    if a.overall_status == "FAILED":
        raise QualityGateError("; ".join(a.warnings))
    return sent
