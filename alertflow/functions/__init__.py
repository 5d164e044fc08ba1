"""Column → Column functions (no Python UDFs)."""

from .classify import (clamp_criticality, color_band, severities_at_least, severity,
                       severity_of)
from .redact import redact, redact_columns
from .text import sanitize_message, truncate_message
from .timefmt import format_event_time, is_rfc3339, parse_event_time

__all__ = [
    "clamp_criticality", "color_band", "severities_at_least", "severity", "severity_of",
    "redact", "redact_columns", "sanitize_message", "truncate_message",
    "format_event_time", "is_rfc3339", "parse_event_time",
]
