"""Criticality clamp, severity classes and display bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Criticality range, severity thresholds (lowest criticality of
# each class, highest class first) and display bands of the terminal client.
MIN_CRITICALITY = 1
MAX_CRITICALITY = 10
SEVERITY_THRESHOLDS = (("critical", 9), ("high", 7), ("medium", 4), ("low", 2))
SEVERITY_DEFAULT = "info"
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_MINIMUM = {**dict(SEVERITY_THRESHOLDS), SEVERITY_DEFAULT: MIN_CRITICALITY}
BAND_THRESHOLDS = (("red", 9), ("orange", 7), ("yellow", 5), ("green", 2))
BAND_DEFAULT = "white"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp_criticality(c) -> Column:
    """Below 1 → 1, above 10 → 10 (F2)."""
    return F.least(F.greatest(_col(c), F.lit(MIN_CRITICALITY)), F.lit(MAX_CRITICALITY))


def _threshold_chain(c: Column, thresholds, default: str) -> Column:
    out = None
    for name, lo in thresholds:
        out = (F.when(c >= lo, F.lit(name)) if out is None
               else out.when(c >= lo, F.lit(name)))
    return out.otherwise(F.lit(default))


def severity(c) -> Column:
    """≥9 critical, ≥7 high, ≥4 medium, ≥2 low, else info."""
    return _threshold_chain(_col(c), SEVERITY_THRESHOLDS, SEVERITY_DEFAULT)


def color_band(c) -> Column:
    """Display band name (F8): ≥9 red, ≥7 orange, ≥5 yellow, ≥2 green, else white."""
    return _threshold_chain(_col(c), BAND_THRESHOLDS, BAND_DEFAULT)


def severity_of(criticality: int) -> str:
    for name, lo in SEVERITY_THRESHOLDS:
        if criticality >= lo:
            return name
    return SEVERITY_DEFAULT


def severities_at_least(min_criticality: int) -> list[str]:
    """Severities that a row with criticality ≥ ``min_criticality`` can have.

    Severity is a monotone function of criticality, so ``criticality >= n``
    implies ``severity IN (...)``; this lets a reader prune store partitions
    before the latest-wins step without changing its answer.
    """
    return sorted({severity_of(c) for c in range(max(min_criticality, MIN_CRITICALITY),
                                                 MAX_CRITICALITY + 1)})
