"""Progress milestones for the ingest stream (A4).

The writer logs a line every 100 stored events with its running counts.  Here
the counts come from the ``ingest`` observation of each micro-batch
(``lastProgress.observedMetrics``), summed per query by a listener on the
driver; no extra job runs.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.store import read_counters

LOG = logging.getLogger("alertflow.ingest")


class IngestProgress(StreamingQueryListener):
    """Running ``processed / errors / malformed`` per query, and the last multiple
    of ``every`` that ``processed`` has passed.  Counters only: nothing grows
    with the stream, and a micro-batch logs one line at most.  ``start`` are the
    totals to go on from (``stored_totals`` after a restart)."""

    def __init__(self, every: int = 100, name: str = "ingest", start: dict[str, int] | None = None):
        self.every = every
        self.name = name
        self.start = {"processed": 0, "errors": 0, "malformed": 0, **(start or {})}
        self.totals: dict[str, dict[str, int]] = {}
        self.milestones: dict[str, int] = {}

    def onQueryStarted(self, event):  # noqa: N802 - Spark's listener interface
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        row = p.observedMetrics.get(self.name) if p.observedMetrics else None
        if row is None:
            return
        qid = str(p.id)
        tot = self.totals.setdefault(qid, dict(self.start))
        before = tot["processed"]
        for k in tot:
            tot[k] += int(row[k] or 0)
        mark = tot["processed"] // self.every * self.every
        if mark > before // self.every * self.every:
            self.milestones[qid] = mark
            LOG.info("processing milestone processed_count=%d error_count=%d", mark, tot["errors"])

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


def stored_totals(spark: SparkSession, root: str) -> dict[str, int]:
    """Sums of the counters that all batches left in the store (A3)."""
    row = read_counters(spark, root).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                                           for c in ("processed", "errors", "malformed")]).first()
    return row.asDict()


def milestone(counters: DataFrame, every: int = 100) -> DataFrame:
    """``processed, errors, malformed, milestone`` of a store (A4): totals over all
    batches and the last multiple of ``every`` that ``processed`` has passed."""
    total = counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("processed", "errors", "malformed")])
    return total.withColumn("milestone", (F.floor(F.col("processed") / every) * every).cast("bigint"))
