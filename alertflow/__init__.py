"""alertflow: security-event ingest, store and queries on Spark.

Decode wire JSON strictly, validate / clean / classify, route rejects to a
dead-letter table, keep a store where the latest write per identity wins,
and answer reader queries, rollups and heat maps — all as DataFrame
operators and Structured Streaming, with no Python UDFs.
"""

from .session import get_session, work_root

__all__ = ["get_session", "work_root"]
