"""Data quality on Spark: profile, score, clean, de-identify and report on tables."""

from tablewise.operators.clean import CleaningError, OpResult
from tablewise.operators.health import health_deductions, health_score, health_zone
from tablewise.operators.pii import detect_pii, mask_pii, pii_summary
from tablewise.plans.registry import OPS, apply_op, preview
from tablewise.plans.replay import replay
from tablewise.sources.readers import load

__all__ = [
    "CleaningError",
    "OPS",
    "OpResult",
    "apply_op",
    "detect_pii",
    "health_deductions",
    "health_score",
    "health_zone",
    "load",
    "mask_pii",
    "pii_summary",
    "preview",
    "replay",
]
