"""Detections per event-time window: repeated, late and empty events; IPv6 forms; turns without a document."""

from datetime import datetime, timedelta

import pytest

from veilframe.functions import rules as R
from veilframe.operators import detect as D
from veilframe.sources import chunks as CH
from veilframe.streaming import jobs as J

START = datetime(2024, 1, 1, 10)
SCHEMA = "id bigint, ts timestamp, text string"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_windowed_detections(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [
        [(1, at(5), "a@b.org and 10.0.0.1"), (2, at(10), "nothing"), (3, at(20), None), (4, at(70), "c@d.org")],
        [(1, at(5), "a@b.org and 10.0.0.1"), (5, at(30), "late but in time d@e.org"), (6, at(130), "x@y.org, x@y.org")],
        [(7, at(15), "too late z@z.org"), (8, at(400), "end@x.org")],
        [(9, at(800), "closes the windows before")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        events = J.read_stream(spark, source, spark.read.parquet(source).schema)
        J.detections_stream(events, "id", "ts", "text", out, state).awaitTermination()
    got = {(r.window_start, r.entity_type): r.n for r in spark.read.parquet(out).collect()}
    assert got == {(START, "EMAIL_ADDRESS"): 2, (START, "IP_ADDRESS"): 1, (at(60), "EMAIL_ADDRESS"): 1,
                   (at(120), "EMAIL_ADDRESS"): 2, (at(360), "EMAIL_ADDRESS"): 1}


ADDRESSES = [("2001:db8::", "2001:db8::"), ("::", "::"), ("1::2", "1::2"), ("::ffff:1.2.3.4", "::ffff:1.2.3.4"),
             ("1::2::3", None), ("12:30:45", None), ("aa:bb:cc:dd:ee:ff", None), ("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8"),
             ("1:2:3:4:5:6:7", None), ("1:2:3:4:5:6:7:8:9", None), ("std::vector", None), ("abc::defg", None),
             ("[2001:db8::1]:443", "2001:db8::1"), ("2001:db8::/32", "2001:db8::"), ("see 2001:db8::7.", "2001:db8::7"),
             ("12345::1", None), ("fe80::1%eth0", "fe80::1"), ("1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:1.2.3.4"), ("1:::2", None),
             ("::1,::2", "::1"), ("from ::1: yes", "::1")]


@pytest.mark.parametrize(("text", "want"), ADDRESSES)
def test_ipv6(text, want, ipv6_found):
    assert ipv6_found[text][:1] == ([] if want is None else [want])


@pytest.fixture(scope="module")
def ipv6_found(spark):
    """The first address in each text by the rule for IPv6 alone."""
    rules = [r for r in R.GENERIC_RULES if r.name == "ipv6"]
    df = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(ADDRESSES)], "doc int, text string")
    out = {t: [] for t, _ in ADDRESSES}
    for r in D.span_rows(D.with_hits(df, rules=rules), "doc").orderBy("doc", "start").collect():
        out[ADDRESSES[r.doc][0]].append(r.original)
    return out


def test_no_half_address_is_left(spark):
    df = spark.createDataFrame([(1, "host 2001:db8:: up")], "doc int, text string")
    rows = D.span_rows(D.with_hits(df), "doc").collect()
    assert [(r.entity_type, r.original) for r in rows] == [("IP_ADDRESS", "2001:db8::")]


def test_transitions_of_null_documents(spark):
    rows = [(None, 0, "u"), (None, 1, "a"), (None, 9, None), (None, 10, "a"), (1, 0, "a"), (1, 5, "a"), (1, 6, "u")]
    df = spark.createDataFrame(rows, "doc int, ord int, role string")
    got = {(r.doc, r.ord): r.changed for r in CH.transitions(df, "doc", "ord", "role", block=4).collect()}
    assert got == {(None, 0): False, (None, 1): True, (None, 9): False, (None, 10): False, (1, 0): False, (1, 5): False,
                   (1, 6): True}
