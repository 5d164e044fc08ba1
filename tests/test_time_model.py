"""Model-based test of RFC 3339 validity and parsing.

The model states the rules: the shape ``YYYY-MM-DDTHH:MM:SS[.frac](Z|±hh:mm)``
with a fraction of any length (point or comma), a real calendar date and
time of day (no 30 February, hour 24 or second 60), an offset of at most
24 hours and 60 minutes; the instant is the local time minus the offset,
kept to microseconds, and fraction digits 7-9 are the sub-microsecond part.
"""

import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from alertflow.functions import parse_event_time

SHAPE = re.compile(r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?"
                   r"(Z|([+-])(\d{2}):(\d{2}))")


def model(text):
    m = SHAPE.fullmatch(text)
    if not m:
        return None
    y, mo, d, h, mi, s = (int(g) for g in m.groups()[:6])
    frac = m.group(7) or ""
    try:
        local = dt.datetime(y, mo, d, h, mi, s, int((frac + "000000")[:6]))
    except ValueError:
        return None
    if m.group(8) == "Z":
        offset = dt.timedelta(0)
    else:
        oh, om = int(m.group(10)), int(m.group(11))
        if oh > 24 or om > 60:
            return None
        offset = dt.timedelta(hours=oh, minutes=om) * (-1 if m.group(9) == "-" else 1)
    return local - offset, int((frac + "000000000")[6:9])


two = st.integers(0, 99).map(lambda n: f"{n:02d}")
text = st.builds(
    lambda y, mo, d, h, mi, s, sep, frac, zone, t: (
        f"{y:04d}-{mo}-{d}{t}{h}:{mi}:{s}{sep + frac if frac else ''}{zone}"),
    st.integers(2, 9998), st.one_of(two, st.sampled_from(["01", "02", "12"])),
    st.one_of(two, st.sampled_from(["28", "29", "30", "31"])),
    st.one_of(two, st.sampled_from(["00", "23", "24"])), two,
    st.one_of(two, st.sampled_from(["59", "60"])), st.sampled_from([".", ","]),
    st.text(alphabet="0123456789", max_size=12),
    st.one_of(st.just("Z"), st.builds(lambda sg, a, b: f"{sg}{a}:{b}", st.sampled_from("+-"),
                                      st.sampled_from(["00", "03", "18", "23", "24", "25"]),
                                      st.sampled_from(["00", "30", "59", "60", "61"])),
              st.sampled_from(["", "z", "+0300", "+03", " Z"])),
    st.sampled_from(["T", "T", "T", " ", "t"]))


@settings(max_examples=10, deadline=None)
@given(st.lists(text, min_size=30, max_size=80))
def test_parse_agrees_with_model(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    p = parse_event_time("s")
    rows = {r["i"]: r for r in df.select("i", p["time"].cast("timestamp_ntz").alias("t"),
                                        p["time_ns_rem"].alias("ns")).collect()}
    for i, t in enumerate(texts):
        want = model(t)
        r = rows[i]
        have = None if r["t"] is None else (r["t"], r["ns"])
        assert have == want, (t, have, want)
