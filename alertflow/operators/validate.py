"""Event validation (V1) and query-argument checks (V2, V3)."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.classify import MAX_CRITICALITY, MIN_CRITICALITY
from ..functions.timefmt import is_rfc3339

# Error codes, the byte limit of a message and the query limits.
CRITICALITY_OUT_OF_RANGE = "criticality_out_of_range"
INVALID_TIMESTAMP = "invalid_timestamp"
MESSAGE_REQUIRED = "message_required"
MESSAGE_TOO_LONG = "message_too_long"
MALFORMED_PAYLOAD = "malformed_payload"
ERROR_CODES = (CRITICALITY_OUT_OF_RANGE, INVALID_TIMESTAMP, MESSAGE_REQUIRED, MESSAGE_TOO_LONG)
MAX_MESSAGE_BYTES = 1000
MIN_LIMIT = 1
MAX_LIMIT = 1000


def error_codes(criticality="criticality", timestamp="timestamp",
                message="event_message", time_ok: Column | None = None) -> Column:
    """All failed checks of one event, as an array (empty = valid) (V1).

    Runs every check and reports every failure together: criticality in
    [1, 10]; RFC 3339 timestamp with offset; message not empty as received
    (blanks pass); message at most 1000 bytes (not characters).
    ``time_ok`` passes an already computed timestamp test.
    """
    c = F.col(criticality) if isinstance(criticality, str) else criticality
    t = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    m = F.col(message) if isinstance(message, str) else message
    checks = [
        (~F.coalesce(c.between(MIN_CRITICALITY, MAX_CRITICALITY), F.lit(False)),
         CRITICALITY_OUT_OF_RANGE),
        (~(is_rfc3339(t) if time_ok is None else time_ok), INVALID_TIMESTAMP),
        (F.coalesce(m, F.lit("")) == "", MESSAGE_REQUIRED),
        (F.coalesce(F.octet_length(m) > MAX_MESSAGE_BYTES, F.lit(False)), MESSAGE_TOO_LONG),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in checks]))


def error_text(codes: Column) -> Column:
    """Readable error for a dead letter; empty codes → NULL."""
    return F.when(F.size(codes) > 0,
                  F.concat(F.lit("validation failed: "), F.array_join(codes, "; ")))


# Fixed value: the one text callers are shown for an out-of-range argument.
MISSING_PUBLIC_MESSAGE = "criticality and limit query parameters are required"
NOT_INTEGER_PUBLIC_MESSAGE = "{} must be an integer"
RANGE_PUBLIC_MESSAGE = "invalid query parameters"


class InvalidQuery(ValueError):
    """Query arguments out of range or not integers.

    ``str(e)`` is the detailed reason; ``e.public_message`` is what a caller
    outside should see: the missing / non-integer texts as they are, and one
    generic text for any range failure.
    """

    def __init__(self, message: str, public_message: str | None = None):
        super().__init__(message)
        self.public_message = public_message or message


def validate_query(min_criticality: int, limit: int) -> tuple[int, int]:
    """``1 ≤ min_criticality ≤ 10`` then ``1 ≤ limit ≤ 1000`` (V2)."""
    if not MIN_CRITICALITY <= min_criticality <= MAX_CRITICALITY:
        raise InvalidQuery(f"min_criticality {min_criticality} out of range "
                           f"[{MIN_CRITICALITY}, {MAX_CRITICALITY}]", RANGE_PUBLIC_MESSAGE)
    if not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise InvalidQuery(f"limit {limit} out of range [{MIN_LIMIT}, {MAX_LIMIT}]",
                           RANGE_PUBLIC_MESSAGE)
    return min_criticality, limit


def _parse_int(text: str) -> int:
    # integer text as the reference's parser takes it: optional sign, ASCII
    # digits, no surrounding blanks
    s = text
    if isinstance(s, bool) or s is None:
        raise ValueError(text)
    if isinstance(s, int):
        return s
    if not isinstance(s, str) or not re.fullmatch(r"[+-]?[0-9]+", s) or not -(1 << 63) <= int(s) < 1 << 63:
        raise ValueError(text)
    return int(s)


def request_arguments(criticality="criticality", limit="limit") -> Column:
    """The checks of V2 and V3 on a table of requests: two text columns to a struct
    ``min_criticality, row_limit, error``.

    ``error`` is the text a caller is shown (null for a good request, whose two
    numbers are set): both arguments present, then integers of 64 bits, then in
    range, the criticality before the limit.
    """
    texts = [F.col(c) if isinstance(c, str) else c for c in (criticality, limit)]
    n, k = [F.when(t.rlike(r"^[+-]?[0-9]+\z"), t.try_cast("bigint")) for t in texts]
    missing = F.coalesce(texts[0], F.lit("")) == ""
    missing = missing | (F.coalesce(texts[1], F.lit("")) == "")
    in_range = n.between(MIN_CRITICALITY, MAX_CRITICALITY) & k.between(MIN_LIMIT, MAX_LIMIT)
    error = (F.when(missing, F.lit(MISSING_PUBLIC_MESSAGE))
             .when(n.isNull(), F.lit(NOT_INTEGER_PUBLIC_MESSAGE.format("criticality")))
             .when(k.isNull(), F.lit(NOT_INTEGER_PUBLIC_MESSAGE.format("limit")))
             .when(~in_range, F.lit(RANGE_PUBLIC_MESSAGE)))
    good = error.isNull()
    return F.struct(F.when(good, n).alias("min_criticality"), F.when(good, k).alias("row_limit"),
                    error.alias("error"))


def parse_query_args(args: Mapping[str, object], missing_as_zero: bool = False) -> tuple[int, int]:
    """Two query parameters from text (V3): ``criticality`` and ``limit``.

    Both are required, then must be integers, then in range.  With
    ``missing_as_zero`` an absent key reads as 0 and so fails the range check
    (the message-request behaviour).
    """
    values = {}
    absent = [k for k in ("criticality", "limit") if args.get(k) is None or args.get(k) == ""]
    if absent and not missing_as_zero:
        raise InvalidQuery(MISSING_PUBLIC_MESSAGE)
    for key in ("criticality", "limit"):
        raw = args.get(key)
        if key in absent:
            values[key] = 0
            continue
        try:
            values[key] = _parse_int(raw)
        except (TypeError, ValueError):
            raise InvalidQuery(NOT_INTEGER_PUBLIC_MESSAGE.format(key)) from None
    return validate_query(values["criticality"], values["limit"])
