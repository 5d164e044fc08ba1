"""An evaluation fence: computed columns stay computed.

Catalyst pushes a filter below the projections that define the columns it
tests, substituting each column by its defining expression.  For cheap
columns that is what we want; for a column defined by JSON parsing,
validation or regex matching it copies the whole expression into the filter
once per reference (checked with ``explain``: ``from_json`` appears twice in
the pushed filter of ``select(from_json(v).a as a, from_json(v).a * 2 as b)
.where(a > 1 and b < 15)``), and join constraint inference then multiplies
those copies until the optimizer runs out of memory.

Passing the computed columns through a one-row ``inline`` generator turns
them into generator outputs, which no filter can be pushed below.  The
expensive expressions themselves stay in an ordinary projection underneath
(whole-stage codegen with common subexpressions shared); the generator only
repacks the already computed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, computed: Sequence[str]) -> DataFrame:
    """Return ``df`` with ``computed`` columns behind an evaluation fence.

    Column order is kept.  Works on batch and streaming frames.
    """
    computed = list(computed)
    rest = [c for c in df.columns if c not in computed]
    packed = F.inline(F.array(F.struct(*[F.col(c) for c in computed])))
    return df.select(*rest, packed).select(*df.columns)
