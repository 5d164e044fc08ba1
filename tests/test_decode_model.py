"""Model-based test of the strict decoder.

A small Python model states the wire decoder's documented rules: one JSON
value with blanks around it; an object or null at the top; keys matched
exactly or ignoring case; ``criticality`` an integer literal within 64 bits;
the other two JSON strings; a wrong type anywhere makes the payload
malformed; absent keys and null give zero values.  Hypothesis builds payloads
(well formed, wrong types, other-case keys, cut or padded text) and the
Spark decoder must agree with the model on each.
"""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from alertflow.sources.codec import decode_events

FIELDS = {"criticality": "int", "timestamp": "str", "eventmessage": "str"}
NAMES = {"criticality": "criticality", "timestamp": "timestamp", "eventmessage": "event_message"}


def _reject_constant(_):
    raise ValueError("NaN / Infinity are not JSON")


def model(text):
    """(malformed, criticality, timestamp, message) as the wire decoder would give."""
    if text is None:
        return (True, None, None, None)
    try:
        pairs_seen = []
        value = json.loads(text, parse_constant=_reject_constant,
                           object_pairs_hook=lambda pairs: pairs_seen.append(pairs) or dict(pairs))
    except (ValueError, RecursionError):
        return (True, None, None, None)
    if value is None:
        return (False, 0, "", "")
    if not isinstance(value, dict):
        return (True, None, None, None)
    top = pairs_seen[-1]  # the outermost object is closed last
    out = {"criticality": 0, "timestamp": "", "eventmessage": ""}
    for key, v in top:
        field = key.lower()
        if field not in FIELDS:
            continue
        kind = FIELDS[field]
        if v is None:
            continue  # null leaves the field as it is
        if kind == "int":
            if isinstance(v, bool) or not isinstance(v, int) or not -(1 << 63) <= v < (1 << 63):
                return (True, None, None, None)
        elif not isinstance(v, str):
            return (True, None, None, None)
        out[field] = v
    return (False, out["criticality"], out["timestamp"], out["eventmessage"])


scalar = st.one_of(
    st.integers(-20, 20), st.integers(-(1 << 64), 1 << 64), st.floats(allow_nan=False,
                                                                     allow_infinity=False),
    st.text(alphabet="abc 7:TZ-", max_size=6), st.booleans(), st.none())
keys = st.sampled_from(["criticality", "timestamp", "eventMessage", "Criticality",
                        "EVENTMESSAGE", "other", "x"])
value = st.one_of(scalar, st.lists(scalar, max_size=2), st.dictionaries(
    st.sampled_from(["a", "criticality"]), scalar, max_size=2))
obj = st.lists(st.tuples(keys, value), max_size=6)


def _render(pairs):
    return "{" + ",".join(json.dumps(k) + ":" + json.dumps(v) for k, v in pairs) + "}"


payload = st.one_of(
    obj.map(_render),
    obj.map(_render).map(lambda s: " \n" + s + "\t "),
    st.tuples(obj.map(_render), st.integers(0, 30)).map(lambda t: t[0][: t[1]]),
    st.tuples(obj.map(_render), st.sampled_from([" x", "}", ",{}", "]", " null"])).map(
        lambda t: t[0] + t[1]),
    st.sampled_from(["null", " null ", "[]", "7", '"s"', "true", "", "NaN", "{}", "[{}]"]),
)


@settings(max_examples=12, deadline=None)
@given(st.lists(payload, min_size=20, max_size=60))
def test_decoder_agrees_with_model(spark, payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, value string")
    got = {r["i"]: r for r in decode_events(df).collect()}
    for i, p in enumerate(payloads):
        want = model(p)
        r = got[i]
        have = (r["malformed"], r["criticality"], r["timestamp"], r["event_message"])
        assert have == want, (p, have, want)
