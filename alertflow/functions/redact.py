"""Credential masking for text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest text kept (characters) and the marker appended when
# cut; then the five masking rules, applied in this order.  The white-space
# classes are written out instead of \s, whose meaning differs between regex
# engines (vertical tab).
MAX_CHARS = 1000
TRUNCATE_SUFFIX = "...[truncated]"
_W = r"[\t\n\f\r ]"
_Q = r'[\t\n\f\r "]*'
_V = r'[^\t\n\f\r "&]+'
URL_SCHEMES = ("https?", "nats", "amqp", "redis", "postgres", "mysql")
PATTERNS = (
    ("(?i)(password|pwd|pass)" + _Q + "[:=]" + _Q + _V, "password=***"),
    ("(?i)(token|bearer" + _W + "+|authorization" + _W + "*[:=]" + _Q
     + "(?:bearer" + _W + "+)?)" + _V, "token=***"),
    ("(?i)(client_secret|secret)" + _Q + "[:=]" + _Q + _V, "secret=***"),
    ("(?i)(api[_-]?key|apikey)" + _Q + "[:=]" + _Q + _V, "api_key=***"),
)
URL_REPLACEMENT = "$1://$2:***@"


def url_pattern(schemes=URL_SCHEMES) -> str:
    """Credentials in a URL, ``scheme://user:password@``; case-sensitive."""
    return "(" + "|".join(schemes) + ")://([^:]+):([^@]+)@"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def redact(c, extra_schemes: tuple[str, ...] = (), null_as_empty: bool = False) -> Column:
    """Cut to 1000 characters (+ marker), then mask credentials.

    ``extra_schemes`` widens the URL rule (for instance ``("tls",)``).
    ``null_as_empty`` gives '' for a NULL input (F11); otherwise NULL stays NULL.
    """
    c = _col(c)
    s = F.when(F.char_length(c) > MAX_CHARS,
               F.concat(F.substring(c, 1, MAX_CHARS), F.lit(TRUNCATE_SUFFIX))).otherwise(c)
    for pattern, replacement in PATTERNS:
        s = F.regexp_replace(s, pattern, replacement)
    s = F.regexp_replace(s, url_pattern(URL_SCHEMES + tuple(extra_schemes)), URL_REPLACEMENT)
    return F.coalesce(s, F.lit("")) if null_as_empty else s


def redact_columns(df: DataFrame, cols: list[str] | None = None, **kw) -> DataFrame:
    """Mask every string column (or the named ones); other types untouched."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: redact(c, **kw) for c in cols})
