"""Wire codec: JSON text ⇄ event columns.

Decoding is strict in the way the wire's reference decoder is: a payload that
is not exactly one JSON value, or whose keys carry the wrong JSON type, is
*malformed*; an object with keys missing (or the literal ``null``) decodes to
zero values and is then *invalid* at validation.  Everything is built-in
column expressions, so it runs inside whole-stage codegen on batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import format_event_time
from ..operators.fence import fence
from ..session import ensure_conf

# JSON type each wire key must have when present (as Spark's
# variant type names); JSON null (VOID) is accepted for every key.
KEY_TYPES = (("criticality", "BIGINT"), ("timestamp", "STRING"), ("eventMessage", "STRING"))
DECODED_COLS = ("raw", "criticality", "timestamp", "event_message", "malformed")


def _exact_variant(obj: Column, key: str) -> Column:
    """The JSON value of ``key`` as a variant (SQL NULL when absent)."""
    return F.try_variant_get(obj, f"$.v.{key}", "variant")


# A key of the wire in any spelling, with its colon.
KEY_MENTION = '(?iu)"(?:' + "|".join(key for key, _ in KEY_TYPES) + r')"\s*:'


def _spelled(e: Column, key: str, ignore_key_case: bool) -> Column:
    """True if an entry's key is ``key``; case is folded as the wire decoder does
    (the long s is an s)."""
    return F.lower(F.translate(e["key"], "\u017f", "s")) == key.lower() if ignore_key_case else e["key"] == key


def _is_type(e: Column, type_name: str) -> Column:
    return F.schema_of_variant(e["value"]) == type_name


def decode_events(df: DataFrame, value_col: str = "value", keep: bool = True,
                  ignore_key_case: bool = True) -> DataFrame:
    """Decode JSON text into ``criticality, timestamp, event_message, malformed``.

    Two parses per payload: wrapped as ``[v]`` it must be an array of exactly
    one element (``json_array_length``, a streaming parse that builds nothing;
    catches syntax errors, trailing text, single quotes, ``{..},{..}`` and
    empty text); wrapped as ``{"v": v}`` it must parse as a variant (catches
    ``{..}]`` and ``NaN``), which gives each key's JSON type and value.  The
    value must be an object or null: once the text is known to parse, its
    first non-blank character tells.  ``raw`` keeps the
    text, ``ingest_seq`` the arrival position when the input has none.
    Keys match ignoring case (``ignore_key_case=False`` for strict matching).
    A key that comes several times, in one spelling or several, is checked each
    time and reads as the last that is not null: such payloads, and those with
    a key missing or escaped, are parsed a third time into their entries in
    order.  Requires ``spark.sql.variant.allowDuplicateKeys=true`` (set here).
    """
    ensure_conf(df.sparkSession)
    v = F.col(value_col).cast("string")
    one = F.json_array_length(F.concat(F.lit("["), v, F.lit("]"))) == 1
    obj = F.try_parse_json(F.concat(F.lit('{"v":'), v, F.lit("}")))
    others = [c for c in df.columns if keep and c not in DECODED_COLS and c != value_col]
    # the two parses, once per row, behind a fence (see operators/fence.py)
    parsed = fence(df.select(*others, v.alias("raw"), one.alias("_one"), obj.alias("_obj")),
                   ["_one", "_obj"])
    obj = F.col("_obj")
    exact = {key: _exact_variant(obj, key) for key, _ in KEY_TYPES}
    parsed = parsed.withColumns({f"_var_{key}": col for key, col in exact.items()})
    # the object's entries in order, only for rows where a key is not there exactly once
    unclear = (F.regexp_count("raw", F.lit(KEY_MENTION)) > len(KEY_TYPES)) | F.contains("raw", F.lit("\\u"))
    for key, _ in KEY_TYPES:
        unclear = unclear | F.col(f"_var_{key}").isNull()
    parsed = parsed.withColumn("_entries", F.when(obj.isNotNull() & unclear, F.map_entries(
        F.from_json("raw", "map<string,variant>"))))
    entries = F.col("_entries")

    def last(key: str, type_name: str) -> Column:
        hits = F.filter(entries, lambda e: _spelled(e, key, ignore_key_case) & _is_type(e, type_name))
        return F.try_element_at(hits, F.lit(-1))["value"]

    def fits(e: Column) -> Column:
        ok = F.lit(True)
        for key, type_name in KEY_TYPES:
            ok = ok & (~_spelled(e, key, ignore_key_case) | _is_type(e, type_name) | _is_type(e, "VOID"))
        return ok

    parsed = parsed.withColumn("_entries_ok", F.coalesce(F.forall("_entries", fits), F.lit(True)))
    parsed = parsed.withColumns({f"_var_{key}": F.when(entries.isNotNull(), last(key, type_name))
                                 .otherwise(F.col(f"_var_{key}")) for key, type_name in KEY_TYPES})
    # the payload parsed, so its first non-blank character tells an object
    # from the other JSON values ('n' is the literal null)
    first_char = F.substring(F.expr("trim(LEADING ' \\t\\n\\r' FROM raw)"), 1, 1)
    types_ok = first_char.isin("{", "n") & F.col("_entries_ok")
    for key, type_name in KEY_TYPES:
        t = F.schema_of_variant(F.col(f"_var_{key}"))
        types_ok = types_ok & (t.isNull() | t.isin(type_name, "VOID"))
    well_formed = F.col("raw").isNotNull() & F.col("_one") & obj.isNotNull() & types_ok
    parsed = parsed.withColumn("malformed", ~F.coalesce(well_formed, F.lit(False)))
    malformed = F.col("malformed")

    def field(key: str, type_name: str, zero) -> Column:
        # the key's value (type already checked); absent keys and null give zero values
        value = F.coalesce(F.try_variant_get(F.col(f"_var_{key}"), "$", type_name.lower()),
                           F.lit(zero))
        return F.when(malformed, F.lit(None)).otherwise(value)

    types = dict(KEY_TYPES)
    out = {
        "raw": F.col("raw"),
        "criticality": field("criticality", types["criticality"], 0).cast("bigint"),
        "timestamp": field("timestamp", types["timestamp"], ""),
        "event_message": field("eventMessage", types["eventMessage"], ""),
        "malformed": malformed,
    }
    if "ingest_seq" not in df.columns and not df.isStreaming:
        # a stream gets its arrival position per micro-batch (foreachBatch)
        out["ingest_seq"] = F.monotonically_increasing_id()
    return parsed.select(*others, *[col.alias(name) for name, col in out.items()])


# Characters that the wire's encoder writes as escapes inside
# strings (they occur nowhere else in JSON text).
ESCAPED = (("<", r"\u003c"), (">", r"\u003e"), ("&", r"\u0026"),
           ("\u2028", r"\u2028"), ("\u2029", r"\u2029"))


def wire_json(value: Column) -> Column:
    """A struct as JSON text, escaped as on the wire."""
    out = F.to_json(value)
    for char, escape in ESCAPED:
        out = F.replace(out, F.lit(char), F.lit(escape))
    return out


def encode_events(df: DataFrame, time_col: str = "time", ns_col: str | None = "time_ns_rem",
                  criticality_col: str = "criticality", message_col: str = "event_message",
                  timestamp_text_col: str | None = None, out_col: str = "value") -> DataFrame:
    """Event columns → JSON text ``{"criticality":..,"timestamp":..,"eventMessage":..}`` (S3).

    Keys in wire order; the time as RFC 3339 in UTC with up to nine fraction
    digits, trailing zeros trimmed.  ``timestamp_text_col`` sends an existing
    text instead of formatting a time (used to build malformed fixtures).
    """
    if timestamp_text_col is not None:
        ts = F.col(timestamp_text_col)
    else:
        ns = F.col(ns_col) if ns_col and ns_col in df.columns else None
        ts = format_event_time(time_col, ns)
    payload = F.struct(F.col(criticality_col).cast("bigint").alias("criticality"),
                       ts.alias("timestamp"),
                       F.col(message_col).alias("eventMessage"))
    return df.withColumn(out_col, wire_json(payload))
