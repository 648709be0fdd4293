"""Reference SQL for the registered queries, written as plain relational steps.

Texts become a line table, each rule marks its matches with control characters, offsets
are running sums over the pieces, overlaps are split between elementary intervals, labels are
row numbers and rewriting is an ordered string aggregate. Only the rule patterns and
scores are shared with the Spark side.
"""

from __future__ import annotations

from veilframe.functions import checksums as C
from veilframe.functions import fakes as K
from veilframe.functions import rules as R
from veilframe.operators import guard as G
from veilframe.plans import corpora as Q

ALL_RULES = R.UK_RULES + R.GENERIC_RULES
DOCS = "SELECT doc_id, text FROM documents"
PLANTED = Q.portable(Q.PLANTED)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lines_of(source: str, key: str = "doc_id", text: str = "text") -> str:
    return (f"SELECT {key}, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS chunk_ord, "
            f"unnest(ls) AS text FROM (SELECT {key}, string_split({text}, chr(10)) AS ls "
            f"FROM ({source}) AS s0) AS s1")


def digits_valid_nhs(d: str) -> str:
    weighted = f"list_sum([CAST(substr({d}, i, 1) AS INTEGER) * (11 - i) for i in range(1, 10)])"
    check = f"((11 - {weighted} % 11) % 11)"
    return f"(length({d}) = 10 AND {check} = CAST(substr({d}, 10, 1) AS INTEGER))"


def codes(s: str) -> str:
    return (f"[CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END "
            f"for c in string_split({s}, '')]")


def mod97(s: str) -> str:
    return (f"list_reduce(list_prepend(0, {codes(s)}), lambda a, x: "
            f"(a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)")


def valid_iban(s: str) -> str:
    return (f"(regexp_full_match({s}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+') AND "
            f"{mod97(f'(substr({s}, 5) || substr({s}, 1, 4))')} = 1)")


def valid_luhn(d: str) -> str:
    doubled = (f"[CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST(substr({d}, i, 1) AS INTEGER) "
               f"ELSE (CAST(substr({d}, i, 1) AS INTEGER) * 2 - "
               f"CASE WHEN substr({d}, i, 1) > '4' THEN 9 ELSE 0 END) END "
               f"for i in range(1, length({d}) + 1)]")
    return f"(length({d}) BETWEEN 12 AND 19 AND list_sum({doubled}) % 10 = 0)"


def rescored(rule: R.Rule) -> str:
    base = f"CAST({rule.score} AS DOUBLE)"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    compact = "upper(replace(m, ' ', ''))"
    if rule.entity == "UK_NHS":
        low = f"WHEN {rule.score} >= 0.5 THEN {base} " if rule.score >= 0.5 else ""
        return (f"CASE WHEN {digits_valid_nhs(digits)} THEN least({base} + 0.45, 0.95) "
                f"{low}END")
    if rule.entity == "UK_IBAN":
        return f"CASE WHEN length({compact}) = 22 AND {valid_iban(compact)} THEN {base} END"
    if rule.entity == "IBAN_CODE":
        return f"CASE WHEN {valid_iban(compact)} THEN {base} END"
    if rule.entity == "CREDIT_CARD":
        return f"CASE WHEN {valid_luhn(digits)} THEN {base} END"
    if rule.name == "ipv6":
        run = f"regexp_replace(m, {q(rule.lead)}, '')"
        valid = C.ipv6_tests(run, lambda v, rx: f"regexp_matches({v}, {q(rx)})",
                             lambda v, rx, new: f"regexp_replace({v}, {q(rx)}, {q(new)})",
                             lambda v: f"len(list_filter(string_split({v}, ':'), lambda g: g <> ''))")
        return f"CASE WHEN {valid} THEN {base} END"
    return base


def rule_rows(rule: R.Rule, lines: str = "lines") -> str:
    rx = ("(?i)" if rule.ignore_case else "") + "(" + rule.regex + ")"
    pieces = (f"SELECT doc_id, chunk_ord, text, generate_subscripts(ps, 1) AS i, "
              f"unnest(ps) AS piece FROM (SELECT *, string_split(regexp_replace(text, {q(rx)}, "
              f"chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM {lines}) AS r0")
    placed = (f"SELECT *, split_part(piece, chr(2), 1) AS m, coalesce(sum(length(replace(piece, "
              f"chr(2), ''))) OVER (PARTITION BY doc_id, chunk_ord ORDER BY i ROWS BETWEEN "
              f"UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ({pieces}) AS r1")
    lead = f"length(regexp_extract(m, {q(rule.lead)}))" if rule.lead else "0"
    scored = (f"SELECT doc_id, chunk_ord, text, CAST(off + {lead} AS INTEGER) AS s, "
              f"CAST(off + length(m) AS INTEGER) AS e, {rescored(rule)} AS sc "
              f"FROM ({placed}) AS r2 WHERE i > 1")
    score = "sc"
    if rule.context:
        words = " OR ".join(f"contains(ctx, {q(w)})" for w in rule.context)
        score = f"CASE WHEN {words} THEN least(greatest(sc + 0.35, 0.4), 1.0) ELSE sc END"
    tokens = "list_filter(regexp_split_to_array(lower(substr(text, 1, s)), '\\s+'), lambda t: t <> '')"
    ctx = (f"SELECT *, array_to_string(list_slice(toks, greatest(len(toks) - 4, 1), len(toks)), ' ')"
           f" AS ctx FROM (SELECT *, {tokens} AS toks FROM ({scored}) AS r3 "
           f"WHERE sc IS NOT NULL) AS r4")
    return (f"SELECT doc_id, chunk_ord, text, s, e, {q(rule.entity)} AS entity, "
            f"round({score}, 2) AS score, {rule.priority} AS prio, {q(rule.name)} AS rule, "
            f"round(sc, 2) AS base FROM ({ctx}) AS r5")


def spans_ctes(source: str, rules=ALL_RULES, threshold: float = R.DEFAULT_THRESHOLD, *,
               chunks: str | None = None, extra: str = "") -> str:
    """CTEs ``lines``, ``cand``, ``best`` and ``spans`` (resolved) of a document source."""
    lines = chunks or lines_of(source)
    cand = " UNION ALL ".join(rule_rows(r) for r in rules)
    out = [
        f"lines AS MATERIALIZED ({lines})",
        f"cand AS MATERIALIZED (SELECT * FROM ({cand}) AS c0 WHERE score >= {threshold}{extra})",
        "best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_ord "
        "ORDER BY score DESC, e - s DESC, prio, s, entity, rule) AS rk FROM cand AS a "
        "WHERE NOT EXISTS (SELECT 1 FROM cand AS b WHERE b.doc_id = a.doc_id "
        "AND b.chunk_ord = a.chunk_ord AND b.entity = a.entity AND b.s <= a.s AND a.e <= b.e "
        "AND (b.score > a.score OR (b.score = a.score AND (b.e - b.s > a.e - a.s OR "
        "(b.e - b.s = a.e - a.s AND b.rule < a.rule))))))",
    ]
    # every place belongs to the best span that covers it
    chunk = "doc_id, chunk_ord"
    out += [
        f"cells AS (SELECT {chunk}, p, lead(p) OVER (PARTITION BY {chunk} ORDER BY p) AS q FROM (SELECT "
        f"{chunk}, s AS p FROM best UNION SELECT {chunk}, e FROM best) AS b0)",
        f"owned AS (SELECT {chunk}, p, q, min(rk) AS rk FROM cells JOIN best USING ({chunk}) "
        f"WHERE s <= p AND q <= e GROUP BY ALL)",
        f"islands AS (SELECT *, sum(fresh) OVER (PARTITION BY {chunk} ORDER BY p) AS island FROM (SELECT *, "
        f"CASE WHEN lag(rk) OVER w = rk AND lag(q) OVER w = p THEN 0 ELSE 1 END AS fresh FROM owned "
        f"WINDOW w AS (PARTITION BY {chunk} ORDER BY p)) AS o0)",
        f"span_parts AS (SELECT {chunk}, rk, min(p) AS s2, max(q) AS e2 FROM islands GROUP BY {chunk}, rk, island)",
        f"spans AS MATERIALIZED (SELECT b.* REPLACE (CAST(s2 AS INTEGER) AS s, CAST(e2 AS INTEGER) AS e), "
        f"substr(text, s2 + 1, e2 - s2) AS original FROM span_parts JOIN best AS b USING ({chunk}, rk))",
    ]
    return ", ".join(out)


LABELLED = ("labelled AS MATERIALIZED (SELECT *, '[' || entity || '_' || row_number() OVER ("
            "PARTITION BY doc_id, entity ORDER BY chunk_ord, s DESC, e DESC) || ']' AS label "
            "FROM spans)")


def spliced(value: str = "label", source: str = "labelled") -> str:
    """CTE ``done(doc_id, chunk_ord, new)``: every chunk with its replacements."""
    return (f"gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id, chunk_ord ORDER BY s)"
            f", 0) AS pe FROM {source}), "
            f"hit AS (SELECT doc_id, chunk_ord, string_agg(substr(text, pe + 1, s - pe) || "
            f"{value}, '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS new "
            f"FROM gaps GROUP BY doc_id, chunk_ord), "
            f"done AS (SELECT l.doc_id, l.chunk_ord, coalesce(h.new, l.text) AS new "
            f"FROM lines AS l LEFT JOIN hit AS h USING (doc_id, chunk_ord))")


WHOLE = "SELECT doc_id, string_agg(new, chr(10) ORDER BY chunk_ord) AS {0} FROM done GROUP BY doc_id"


def redacted(source: str = DOCS, **kw) -> str:
    """WITH clause up to ``done`` for redaction of a source."""
    return f"WITH {spans_ctes(source, **kw)}, {LABELLED}, {spliced()}"


def found(source: str = DOCS, **kw) -> str:
    return f"WITH {spans_ctes(source, **kw)}"


SPAN_COLUMNS = ("doc_id, chunk_ord, entity AS entity_type, s AS start, e AS \"end\", score, rule, "
                "original")


def rules_for(*entities: str) -> tuple[R.Rule, ...]:
    return tuple(r for r in ALL_RULES if r.entity in entities)


# Fakes -------------------------------------------------------------------------------

def word(h: str, k: int) -> str:
    return f"CAST('0x' || substr({h}, {8 * k + 1}, 8) AS BIGINT)"


def byte(h: str, k: int) -> str:
    return f"CAST('0x' || substr({h}, {2 * k + 1}, 2) AS BIGINT)"


def pick(pool, n: str) -> str:
    return "[" + ", ".join(q(p) for p in pool) + f"][{n} % {len(pool)} + 1]"


def composed(n: str, *pools) -> str:
    below, parts = 1, []
    for pool in pools:
        parts.append(pick(pool, f"({n} // {below})"))
        below *= len(pool)
    return "(" + " || ".join(parts) + ")"


def surname(n: str) -> str:
    return composed(n, K.HEADS, K.MIDDLES, K.ENDINGS)


def letter(alphabet: str, n: str) -> str:
    return f"substr('{alphabet}', {n} % {len(alphabet)} + 1, 1)"


def digits(n: str, k: int) -> str:
    return f"lpad(CAST({n} % {10 ** k} AS VARCHAR), {k}, '0')"


def day(h: str, k: int = 0) -> str:
    return (f"CAST(DATE '{K.BIRTH_START}' + CAST({word(h, k)} % {K.BIRTH_DAYS} AS INTEGER) "
            f"AS VARCHAR)")


def fake_iban(h: str) -> str:
    bban = ("(" + " || ".join(letter(K.LETTERS, byte(h, k)) for k in range(4))
            + f" || {digits(word(h, 1), 7)} || {digits(word(h, 2), 7)})")
    check = f"(98 - {mod97(f'({bban} || {q(chr(71) + chr(66) + chr(48) * 2)})')})"
    return f"'GB' || lpad(CAST({check} AS VARCHAR), 2, '0') || {bban}"


def fake_card(h: str) -> str:
    body = f"('4' || {digits(word(h, 0), 7)} || {digits(word(h, 1), 7)})"
    total = ("list_sum([CASE WHEN i % 2 = 0 THEN CAST(substr(" + body + ", i, 1) AS INTEGER) ELSE "
             "CAST(substr(" + body + ", i, 1) AS INTEGER) * 2 - CASE WHEN substr(" + body
             + ", i, 1) > '4' THEN 9 ELSE 0 END END for i in range(1, 16)])")
    return f"{body} || CAST((10 - {total} % 10) % 10 AS VARCHAR)"


def fake_nhs(h: str) -> str:
    n = digits(word(h, 0), 9)
    chk = ("((11 - list_sum([CAST(substr({0}, i, 1) AS INTEGER) * (11 - i) for i in range(1, 10)])"
           " % 11) % 11)")
    moved = f"(substr({n}, 1, 8) || CAST((CAST(substr({n}, 9, 1) AS INTEGER) + 1) % 10 AS VARCHAR))"
    nine = f"(CASE WHEN {chk.format(n)} = 10 THEN {moved} ELSE {n} END)"
    return (f"substr({nine}, 1, 3) || ' ' || substr({nine}, 4, 3) || ' ' || substr({nine}, 7, 3) "
            f"|| CAST({chk.format(nine)} AS VARCHAR)")


def fake_licence(h: str) -> str:
    d = day(h, 1)
    at = " || ".join(f"substr({d}, {i}, {n})" for i, n in ((3, 1), (6, 1), (4, 1), (7, 1), (9, 2)))
    two = f"{letter(K.LETTERS, byte(h, 8))} || {letter(K.LETTERS, byte(h, 9))}"
    end = f"{letter(K.LETTERS, byte(h, 10))} || {letter(K.LETTERS, byte(h, 11))}"
    return f"rpad(upper(substr({pick(K.LAST_NAMES, word(h, 0))}, 1, 5)), 5, 'X') || {at} || {two} || '9' || {end}"


def fake(entity: str, h: str) -> str:
    first, last = pick(K.FIRST_NAMES, word(h, 0)), pick(K.LAST_NAMES, word(h, 1))
    if entity == "PERSON":
        return f"{first} || ' ' || {pick(K.FIRST_NAMES, word(h, 3))} || ' ' || {surname(word(h, 1))}"
    if entity == "ORGANIZATION":
        return (f"{surname(word(h, 0))} || ' ' || {surname(word(h, 1))} || ' ' || "
                f"{pick(K.COMPANY_ENDINGS, word(h, 2))}")
    if entity == "LOCATION":
        return composed(word(h, 0), K.PLACE_KINDS, K.HEADS, K.MIDDLES, K.PLACE_ENDINGS)
    if entity == "EMAIL_ADDRESS":
        return f"lower({first}) || '.' || lower({last}) || {digits(word(h, 2), 6)} || '@example.com'"
    if entity in ("PHONE_NUMBER", "UK_PHONE"):
        return f"'07700 9' || {digits(word(h, 0), 5)}"
    if entity == "UK_POSTCODE":
        inward = K.POSTCODE_INWARD_LETTERS
        return (f"{letter(K.LETTERS, byte(h, 0))} || {letter(K.LETTERS, byte(h, 1))} || "
                f"{digits(byte(h, 2), 1)} || ' ' || {digits(byte(h, 3), 1)} || "
                f"{letter(inward, byte(h, 4))} || {letter(inward, byte(h, 5))}")
    if entity == "DATE_TIME":
        return day(h)
    if entity in ("IBAN_CODE", "UK_IBAN"):
        return fake_iban(h)
    if entity == "CREDIT_CARD":
        return fake_card(h)
    if entity == "IP_ADDRESS":
        return " || '.' || ".join(f"CAST({byte(h, k)} AS VARCHAR)" for k in range(4))
    if entity == "NRP":
        return (" || ".join(letter(K.LETTERS, byte(h, k)) for k in range(3))
                + f" || '-' || {digits(word(h, 1), 4)}")
    if entity == "UK_NI":
        return (f"{letter(K.NI_PREFIX_LETTERS, byte(h, 0))} || "
                f"{letter(K.NI_PREFIX_LETTERS, byte(h, 1))} || {digits(word(h, 1), 6)} || "
                f"{letter(K.NI_SUFFIX_LETTERS, byte(h, 2))}")
    if entity == "UK_NHS":
        return fake_nhs(h)
    if entity == "UK_DRIVING_LICENCE":
        return fake_licence(h)
    return f"'[' || {q(entity)} || '_FAKE]'"


def gen(*entities: str) -> str:
    cols = ", ".join(f"{fake(e, 'h')} AS {e.lower()}" for e in entities)
    return f"SELECT c_custkey, {cols} FROM (SELECT c_custkey, sha256(c_name) AS h FROM customer) AS c"


def mapped(session: str, source: str = DOCS, **kw) -> str:
    """CTEs to ``mapping(original_hash, entity, original, fake_value, n)`` of one session.

    A fake that an earlier row holds, or that is a real value, is made anew from another
    hash; two such rounds are enough for the given tables.
    """
    kinds = sorted({r.entity for r in kw.get("rules", ALL_RULES)})
    cases = " ".join(f"WHEN {q(e)} THEN {fake(e, 'h')}" for e in kinds)
    out = [spans_ctes(source, **kw),
           "firsts AS MATERIALIZED (SELECT sha256(original) AS original_hash, any_value(original) AS "
           "original, arg_min(entity, (doc_id, chunk_ord, -s)) AS entity, arg_min(doc_id, (doc_id, "
           "chunk_ord, -s)) AS first_doc, count(*) AS n FROM spans GROUP BY 1)",
           f"m0 AS MATERIALIZED (SELECT *, 0 AS attempt, CASE entity {cases} END AS fake_value FROM "
           f"(SELECT *, sha256({q(session)} || original_hash) AS h FROM firsts) AS f)"]
    for k in (1, 2):
        out.append(
            f"m{k} AS MATERIALIZED (SELECT * EXCLUDE (lost, made, fake_value, attempt), CASE WHEN lost "
            f"THEN {k} ELSE attempt END AS attempt, CASE WHEN lost THEN made ELSE fake_value END AS "
            f"fake_value FROM (SELECT * EXCLUDE (h), CASE entity {cases} END AS made FROM (SELECT "
            f"* EXCLUDE (h), sha256({q(session)} || original_hash || '#{k}') AS h, "
            f"row_number() OVER (PARTITION BY fake_value ORDER BY attempt, original_hash) > 1 OR "
            f"sha256(fake_value) IN (SELECT original_hash FROM firsts) AS lost "
            f"FROM m{k - 1}) AS a) AS b)".replace("EXCLUDE (h), CASE", "EXCLUDE (h), h, CASE"))
    out.append("mapping AS MATERIALIZED (SELECT * FROM m2)")
    return ", ".join(out)
