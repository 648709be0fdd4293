"""Scores of the rules with and without context, and the checksums."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions import checksums as C
from veilframe.functions import rules as R
from veilframe.functions import spans as S


def found(spark, text, entities=None, threshold=0.0, rules=None):
    rules = rules or R.default_rules(entities)
    row = spark.createDataFrame([(text,)], "text string").select(
        F.expr(S.find_spans("text", rules, threshold)).alias("s")).first()
    return [(text[s["start"]:s["end"]], s["entity"], s["score"], s["rule"]) for s in row["s"]]


SCORES = [
    ("x AB123456C", "UK_NI", 0.85), ("NI number AB123456C", "UK_NI", 1.0),
    ("x 943 476 5919", "UK_NHS", 0.95), ("x 943 476 5918", "UK_NHS", 0.5),
    ("nhs no 943 476 5918", "UK_NHS", 0.85), ("nhs no 943 476 5919", "UK_NHS", 1.0),
    ("x 9434765919", "UK_NHS", 0.75), ("NHS number 9434765919", "UK_NHS", 1.0),
    ("x SW1A 2AA", "UK_POSTCODE", 0.6), ("postcode SW1A 2AA", "UK_POSTCODE", 0.95),
    ("x M25", "UK_POSTCODE", 0.6),
    ("x 07700 900123", "UK_PHONE", 0.75), ("call 07700 900123", "UK_PHONE", 1.0),
    ("x 0207 9460958", "UK_PHONE", 0.65), ("x+44 7700 900 123", "UK_PHONE", 0.8),
    ("x MORGA753116SM9IJ", "UK_DRIVING_LICENCE", 0.7),
    ("dvla MORGA753116SM9IJ", "UK_DRIVING_LICENCE", 1.0),
    ("x GB29NWBK60161331926819", "UK_IBAN", 0.8),
    ("iban GB29 NWBK 6016 1331 9268 19", "UK_IBAN", 1.0),
    ("x a.b@c.org", "EMAIL_ADDRESS", 1.0), ("x +1 (663) 555-6869", "PHONE_NUMBER", 0.4),
    ("call +1 (663) 555-6869", "PHONE_NUMBER", 0.75),
    ("x 4111 1111 1111 1111", "CREDIT_CARD", 1.0), ("x 10.0.0.1", "IP_ADDRESS", 0.6),
    ("x 2001:db8::1", "IP_ADDRESS", 0.6), ("x 2024-01-31", "DATE_TIME", 0.6),
    ("x 31/01/2024", "DATE_TIME", 0.6), ("x 3 March 2024", "DATE_TIME", 0.6),
    ("Dr Ann Lee came", "PERSON", 0.85), ("a Welsh poet", "NRP", 0.85),
    ("at Red Kite Ltd", "ORGANIZATION", 0.85), ("x DE89370400440532013000", "IBAN_CODE", 1.0),
]


def test_score_goldens(spark):
    rows = spark.createDataFrame([(i, t, e) for i, (t, e, _) in enumerate(SCORES)],
                                 "i int, text string, entity string")
    own = f"filter({S.candidate_spans('text', R.default_rules(), 0.0)}, s -> s.entity = entity)"
    spans = rows.select("i", F.expr(S.dedupe(own)).alias("s")).orderBy("i").collect()
    got = [(SCORES[r["i"]][0], SCORES[r["i"]][1], [s["score"] for s in r["s"]]) for r in spans]
    assert got == [(t, e, [v]) for t, e, v in SCORES]


@pytest.mark.parametrize("text", [
    "EF345678E", "GH456789F", "x 1234567890", "GB00NWBK60161331926819", "4111 1111 1111 1112",
    "no personal data", "", "   ", "tel +44 7700 900 123",
])
def test_not_found_at_default(spark, text):
    wanted = [r for r in found(spark, text, threshold=R.DEFAULT_THRESHOLD)
              if r[3] != "uk_landline"]
    assert wanted == []


def test_leading_plus_rule_is_optional(spark):
    text = "tel +44 7700 900 123"
    assert found(spark, text, rules=(R.UK_INTL_LEAD,)) == [
        ("+44 7700 900 123", "UK_PHONE", 1.0, "uk_intl_lead")]


def test_outward_postcode_boundary(spark):
    assert found(spark, "x A4 y", ["UK_POSTCODE"], 0.6)
    assert not found(spark, "x A4 y", ["UK_POSTCODE"], 0.61)


def test_unicode_classes(spark):
    assert found(spark, "é943 476 5919", ["UK_NHS"]) == []
    assert found(spark, "943 476 5919", ["UK_NHS"])[0][2] == 0.95
    arabic = "".join(chr(0x660 + int(c)) for c in "9434765919")
    assert found(spark, arabic, ["UK_NHS"])[0][2] == 0.75


def test_pii_text(spark, pii_text):
    got = [(o, e) for line in pii_text.split("\n") for o, e, _, _ in found(spark, line, None, 0.6)]
    assert got == [
        ("AB123456C", "UK_NI"), ("john.smith@example.co.uk", "EMAIL_ADDRESS"),
        ("07700 900123", "UK_PHONE"), ("943 476 5919", "UK_NHS"), ("SW1A 2AA", "UK_POSTCODE"),
        ("GB29NWBK60161331926819", "UK_IBAN"), ("Sarah Mitchell", "PERSON")]


def _check(digits):
    c = 11 - sum(int(d) * (10 - i) for i, d in enumerate(digits[:9])) % 11
    return (0 if c == 11 else c) == int(digits[9]) and c != 10


def test_checksums_against_plain_python(spark):
    numbers = [f"{(i * 7919 + 943476591) * 13 % 10**10:010d}" for i in range(400)]
    ibans = [f"GB{i % 97:02d}NWBK{(i * 104729 + 60161331926819) % 10**14:014d}"
             for i in range(400)]
    cards = [f"{(i * 99991 + 4111111111111111) % 10**16:016d}" for i in range(400)]

    def iban(v):
        r = v[4:] + v[:4]
        return int("".join(str(int(c, 36)) for c in r)) % 97 == 1

    def luhn(v):
        t = 0
        for k, c in enumerate(reversed(v)):
            d = int(c) * (2 if k % 2 else 1)
            t += d - 9 if d > 9 else d
        return t % 10 == 0

    df = spark.createDataFrame(list(zip(numbers, ibans, cards)), "n string, b string, c string")
    rows = df.selectExpr("n", "b", "c", f"{C.nhs_valid('n')} AS nv", f"{C.iban_valid('b', 22)} AS bv",
                         f"{C.luhn_valid('c')} AS cv").collect()
    for r in rows:
        assert (r.nv, r.bv, r.cv) == (_check(r.n), iban(r.b), luhn(r.c))


def test_register_rule(spark):
    rule = R.Rule("staff", "STAFF_ID", r"\bS-\d{4}\b", 0.7)
    R.register_rule(rule)
    try:
        with pytest.raises(ValueError):
            R.register_rule(rule)
        assert found(spark, "see S-1234") == [("S-1234", "STAFF_ID", 0.7, "staff")]
    finally:
        R.unregister_rule("staff")
    assert "staff" not in [r.name for r in R.default_rules()]


def test_parse_entities():
    assert R.parse_entities(" uk_ni, PERSON ,") == ["UK_NI", "PERSON"]
    assert R.parse_entities("") is None and R.parse_entities(None) is None


def test_gates_and_needs_hold_for_every_match(spark):
    """The cheap tests must never hide a match of the full pattern."""
    texts = [t for t, _, _ in SCORES] + ["Mrs. Ö. Äh", "Prof Li", "Dear\tMs Bo", "Poles Sikhs",
                                         "ACME PLC", "call: 0123 4567890", "FE80:0:0:0:1:2:3:4",
                                         "1 May 2020 ab 12 34 56 a", "gb29nwbk60161331926819"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    import dataclasses
    for rule in R.default_rules():
        bare = dataclasses.replace(rule, gate=None, gate_words=(), needs=None)
        row = df.select(
            F.expr(S.candidate_spans("text", (bare,), 0.0)).alias("plain"),
            F.expr(f"IF({S.may_match('text', (rule,))}, "
                   f"{S.candidate_spans('text', (rule,), 0.0)}, {S.NO_SPANS})").alias("gated"))
        assert row.filter("plain != gated").count() == 0, rule.name
