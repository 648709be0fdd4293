"""Span offsets, overlap resolution and splicing against brute force."""

import random
import re

from pyspark.sql import functions as F

from veilframe.functions import arrays as A
from veilframe.functions import layout as L
from veilframe.functions import rules as R
from veilframe.functions import spans as S
from veilframe.functions import text as X

ALPHABET = ["a", "B", "7", "12", " ", "  ", "é", "😀", "@", "x.com", "\n", ".", "10.0.0.1",
            "AB123456C", "07700 900123", "m@n.org"]


def texts(n, seed, pieces=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(pieces))) for _ in range(n)]


def test_match_offsets_equal_python(spark):
    rx = r"\d+|[A-Z]+"
    df = spark.createDataFrame([(t,) for t in texts(300, 1)], "text string")
    for r in df.select("text", F.expr(S.matches("text", rx)).alias("m")).collect():
        want = [(m.start(), m.group()) for m in re.finditer(rx, r.text, re.ASCII)]
        assert [(m["start"], m["m"]) for m in r.m] == want


def test_running_sum_long_and_short(spark):
    for n in (0, 1, 5, A.BLOCK, A.BLOCK + 1, 3 * A.BLOCK + 7):
        values = [(i * 7) % 11 for i in range(n)]
        total, want = 0, []
        for v in values:
            total += v
            want.append(total)
        row = spark.createDataFrame([(values,)], "v array<int>").selectExpr(
            f"{A.running_sum('v')} AS s").first()
        assert row.s == want


def test_spans_never_overlap_and_redact_matches(spark):
    rules = R.default_rules()
    df = spark.createDataFrame(list(enumerate(texts(300, 2))), "i int, text string")
    rows = df.select("text", F.expr(S.find_spans("text", rules, 0.3)).alias("s"),
                     F.expr(S.candidate_spans("text", rules, 0.3)).alias("c")).collect()
    for r in rows:
        for a, b in zip(r.s, r.s[1:]):
            assert a["end"] <= b["start"]
        assert [tuple(s) for s in r.s] == brute_resolve([tuple(c) for c in r.c])


def brute_resolve(cand):
    """Spans are (start, end, entity, score, priority, rule)."""
    kept = [s for s in cand if not any(
        o[2] == s[2] and o[0] <= s[0] and s[1] <= o[1] and
        (o[3] > s[3] or (o[3] == s[3] and (o[1] - o[0] > s[1] - s[0] or (
            o[1] - o[0] == s[1] - s[0] and o[5] < s[5])))) for o in cand)]
    owner = {}
    for s in sorted(kept, key=lambda s: (-s[3], s[0] - s[1], s[4], s[0], s[2], s)):
        for place in range(s[0], s[1]):
            owner.setdefault(place, s)
    out = []
    for place in sorted(owner):
        s = owner[place]
        if out and out[-1][0] == s and out[-1][2] == place:
            out[-1][2] = place + 1
        else:
            out.append([s, place, place + 1])
    return sorted((a, b, *s[2:]) for s, a, b in out)


def test_resolve_random_intervals(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(200):
        spans = []
        for _ in range(rng.randrange(12)):
            a = rng.randrange(40)
            spans.append((a, a + rng.randrange(1, 9), rng.choice("XYZ"),
                          rng.choice([0.5, 0.75, 1.0]), rng.choice([0, 1]), rng.choice("pqr")))
        cases.append((list(dict.fromkeys(spans)),))
    df = spark.createDataFrame(cases, f"c array<{S.SPAN_TYPE}>")
    for r in df.select("c", F.expr(S.resolve("c")).alias("s")).collect():
        assert [tuple(s) for s in r.s] == brute_resolve([tuple(c) for c in r.c])


def test_rebuild_with_every_line_break(spark):
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    text = "".join(f"a{i}@b.org and 10.0.0.{i}{b}plain{b}" for i, b in enumerate(breaks)) + "end"
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select("text", F.expr(L.chunks_of("text")).alias("chunks"), F.expr(L.hits_of_text(
        "text", R.default_rules())).alias("hits")).withColumn(
        "out", F.expr(L.rebuilt("text", L.labelled(L.numbered("hits"))))).first()
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    assert [c["text"] for c in row.chunks] == [
        line.rstrip("\r\n") for line in plain.splitlines(keepends=True)]
    want = plain
    for i in range(len(breaks)):
        want = want.replace(f"a{i}@b.org", f"[EMAIL_ADDRESS_{i + 1}]")
        want = re.sub(rf"10\.0\.0\.{i}(?!\d)", f"[IP_ADDRESS_{i + 1}]", want)
    assert row.out == want


def test_labels_run_right_to_left_in_a_line(spark):
    df = spark.createDataFrame([("a@b.org c@d.org\ne@f.org",)], "text string")
    row = df.select("text", F.expr(L.hits_of_text("text", R.default_rules())).alias("hits")).select(
        F.expr(L.rebuilt("text", L.labelled(L.numbered("hits")))).alias("out")).first()
    assert row.out == "[EMAIL_ADDRESS_2] [EMAIL_ADDRESS_1]\n[EMAIL_ADDRESS_3]"


def test_display_helpers(spark):
    text = "<b>\"O'Neil\" & [UK_NI_12]\nALL CAPS LINE"
    row = spark.createDataFrame([(text,)], "t string").selectExpr(
        f"{X.highlighted('t')} AS h", f"{X.label_runs('t')} AS r", f"{X.masked('t')} AS m",
        f"{X.is_heading(chr(39) + 'ALL CAPS' + chr(39))} AS yes",
        f"{X.is_heading(chr(39) + '1 CAPS' + chr(39))} AS no",
        f"{X.is_heading(chr(39) + 'END.' + chr(39))} AS dot").first()
    assert row.h == ("&lt;b&gt;&quot;O&#x27;Neil&quot; &amp; <mark class=\"pii\">[UK_NI_12]</mark>"
                     "<br>ALL CAPS LINE")
    assert [(r["text"], r["is_label"]) for r in row.r] == [
        ("<b>\"O'Neil\" & ", False), ("[UK_NI_12]", True), ("\nALL CAPS LINE", False)]
    assert (row.m, row.yes, row.no, row.dot) == ("<b>***", True, False, False)


def test_splice_and_rebuild_with_many_parts(spark):
    """More parts than a segment holds, on one line and over lines, against plain slicing."""
    rng = random.Random(11)
    rows = []
    for case in range(12):
        lines = ["".join(rng.choice("abcé😀 ") for _ in range(rng.choice([3, 40, 900]))) + "\n"
                 for _ in range(rng.choice([1, 2, 9]))]
        parts, want = [], []
        for k, line in enumerate(lines):
            pos, out = 0, ""
            while pos < len(line) - 3 and rng.random() < 0.995:
                start = pos + rng.randrange(3)
                end = min(start + rng.randrange(1, 4), len(line) - 1)
                if end <= start:
                    break
                parts.append((k, start, end, f"<{len(parts)}>"))
                out += line[pos:start] + parts[-1][3]
                pos = end
            want.append(out + line[pos:])
        first = [p for p in parts if p[0] == 0]
        rows.append(("".join(lines), parts, "".join(want), lines[0], first, want[0]))
    kind = f"{L.PARTS_TYPE}"
    df = spark.createDataFrame(
        rows, f"text string, parts {kind}, want string, line string, first {kind}, one string")
    got = df.select("want", "one", F.expr(L.rebuilt("text", "parts")).alias("r"),
                    F.expr(S.splice("line", "first")).alias("s")).collect()
    assert max(len(r[1]) for r in rows) > 3 * S.SEGMENT
    for r in got:
        assert r.r == r.want and r.s == r.one
