"""Strict JSON decode (S2) on the payload classes of SURVEY §2.2, and encode (S3)."""

import datetime as dt

from alertflow.sources.codec import decode_events, encode_events

GOOD = '{"criticality":7,"timestamp":"2024-01-15T10:30:00Z","eventMessage":"x"}'
CASES = [
    (GOOD, False, (7, "2024-01-15T10:30:00Z", "x")),
    ("{}", False, (0, "", "")),
    ('{"criticality":null}', False, (0, "", "")),
    ("null", False, (0, "", "")),
    ("", True, None),
    ("[]", True, None),
    ("[" + GOOD + "]", True, None),
    ("{bad", True, None),
    ('{"criticality":"7"}', True, None),
    ('{"criticality":7.5}', True, None),
    ('{"criticality":7.0}', True, None),
    ('{"criticality":12345678901234567890}', True, None),
    ('{"criticality":1e2}', True, None),
    ('{"timestamp":5}', True, None),
    ('{"timestamp":{"a":1}}', True, None),
    ('{"eventMessage":true}', True, None),
    (GOOD + " trailing", True, None),
    (GOOD + GOOD, True, None),
    (GOOD + "," + GOOD, True, None),
    ("{'criticality':7}", True, None),
    ('{"criticality":1,"criticality":2}', False, (2, "", "")),
    ('{"criticality":3,"other":[1,2]}', False, (3, "", "")),
    ('{"criticality":5,"criticality":null}', False, (5, "", "")),
    ('{"criticality":"5","criticality":6}', True, None),
    ('{"eventMessage":"a","criticality":6,"timestamp":"t","eventmessage":"b"}', False, (6, "t", "b")),
    ('{"EventMessage":"a","criticality":6,"timestamp":"t","eventMessage":"b"}', False, (6, "t", "b")),
    ('{"criticality":6,"timestamp":"t","eventMessage":"b","CRITICALITY":[6]}', True, None),
    ('{"eventMessage":"b","event\\u004dessage":"c","timestamp":"t","criticality":1}', False, (1, "t", "c")),
    ('{"eventMessage":"b","eventMe\u017f\u017fage":"c","timestamp":"t","criticality":1}', False, (1, "t", "c")),
    ('{"eventMessage":"say \\"criticality\\": \\u0041","x":{"criticality":"no"},"criticality":1}', False,
     (1, "", 'say "criticality": A')),
    ('{"a":1}]', True, None),
    ("NaN", True, None),
    ('{"criticality":07}', True, None),
    ('{"criticality":1,}', True, None),
    ("7", True, None),
    ('"text"', True, None),
    (' \t{"criticality":3}\n', False, (3, "", "")),
    ('{"criticality":-0}', False, (0, "", "")),
    (None, True, None),
    ('{"Criticality":7}', False, (7, "", "")),
    ('{"CRITICALITY":4,"TimeStamp":"2024-01-15T10:30:00Z","eventmessage":"m"}', False,
     (4, "2024-01-15T10:30:00Z", "m")),
    ('{"Criticality":"7"}', True, None),
    ('{"criticality":Infinity}', True, None),
    ('{"criticality":-Infinity}', True, None),
    ('{"criticality":1 /* c */}', True, None),
    ('// c\n{"criticality":1}', True, None),
    ('{"criticality":1}]{}', True, None),
    ('{"criticality":1}{}', True, None),
    ('{"criticality":1,"x":[1,]}', True, None),
    ('{"criticality":true}', True, None),
    ('{"eventMessage":"tab\there"}', True, None),
    ('{"eventMessage":"esc\\u00e9"}', False, (0, "", "escé")),
]


def test_decode_truth_table(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(CASES)], "i int, value string")
    out = {r["i"]: r for r in decode_events(df).collect()}
    for i, (payload, malformed, values) in enumerate(CASES):
        r = out[i]
        assert r["malformed"] is malformed, payload
        if malformed:
            assert r["criticality"] is None, payload
        else:
            assert (r["criticality"], r["timestamp"], r["event_message"]) == values, payload


def test_decode_keeps_raw_and_position(spark):
    df = spark.createDataFrame([(GOOD,)], "value string")
    r = decode_events(df).collect()[0]
    assert r["raw"] == GOOD and r["ingest_seq"] is not None


def test_encode_wire_order_and_roundtrip(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15, 10, 30, 0, 123000), 0, 7, 'say "hi"'),
                                (dt.datetime(2024, 1, 15, 10, 30), 456, 1, "plain")],
                               "time timestamp_ntz, time_ns_rem smallint, criticality bigint, "
                               "event_message string")
    enc = encode_events(df)
    vals = [r["value"] for r in enc.collect()]
    assert vals[0] == ('{"criticality":7,"timestamp":"2024-01-15T10:30:00.123Z",'
                       '"eventMessage":"say \\"hi\\""}')
    assert vals[1] == ('{"criticality":1,"timestamp":"2024-01-15T10:30:00.000000456Z",'
                       '"eventMessage":"plain"}')
    back = decode_events(enc.select("value")).collect()
    assert [(r["criticality"], r["event_message"], r["malformed"]) for r in back] == \
        [(7, 'say "hi"', False), (1, "plain", False)]


def test_strict_key_case_option(spark):
    df = spark.createDataFrame([('{"Criticality":7}',)], "value string")
    r = decode_events(df, ignore_key_case=False).collect()[0]
    assert (r["malformed"], r["criticality"]) == (False, 0)


def test_characters_that_the_wire_escapes(spark):
    import datetime as dt

    from alertflow.sources.codec import decode_events, encode_events
    text = "a<b> & c\u2028d\u2029 \"q\" \\ é"
    df = spark.createDataFrame([(3, dt.datetime(2025, 5, 4, 3, 2, 1), text)],
                               "criticality bigint, time timestamp, event_message string")
    sent = encode_events(df)
    raw = sent.first()["value"]
    assert raw == ('{"criticality":3,"timestamp":"2025-05-04T03:02:01Z","eventMessage":"a\\u003cb\\u003e \\u0026 '
                   'c\\u2028d\\u2029 \\"q\\" \\\\ é"}')
    assert decode_events(sent.select("value")).first()["event_message"] == text
