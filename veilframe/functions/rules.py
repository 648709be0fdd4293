"""Detection rules: a small table of patterns, scores, context words and validators.

A rule is plain data; its tests are SQL expressions, so detection stays inside the JVM.
Patterns run with Unicode classes, like the Python ``re`` module on ``str``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from veilframe.functions import checksums
from veilframe.functions.arrays import lit

DEFAULT_THRESHOLD = 0.6
CONTEXT_BOOST = 0.35
CONTEXT_FLOOR = 0.4
CONTEXT_WINDOW = 5

# The entities.
ENTITIES = (
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS",
    "LOCATION", "DATE_TIME", "NRP", "ORGANIZATION", "UK_NI", "UK_NHS", "UK_POSTCODE",
    "UK_PHONE", "UK_DRIVING_LICENCE", "UK_IBAN",
)


# Coarse gates: a text with none of these characters or words is skipped after one scan.
DIGIT = r"\p{Nd}"
AT = "@"
COLON = ":"


def initials(words: Iterable[str]) -> str:
    """Look-ahead for the first letters of ``words``; it fails fast at most positions."""
    return "(?=[" + "".join(sorted({re.escape(w[0]) for w in words})) + "])"


@dataclass(frozen=True)
class Rule:
    """One pattern of one entity.

    ``rescore`` is an SQL expression over ``{m}``, the match, and ``{s}``, the score: the new
    score, or NULL to discard the match. Every text with a match holds a character of the
    class ``gate``, or one of the words ``gate_words``; the gates of all rules are tested
    together in one scan. ``needs`` is a pattern found in every text with a match, cheaper
    than ``regex`` because it starts at a rare character.
    ``lead`` is a pattern cut off the front of a match.
    """

    name: str
    entity: str
    regex: str
    score: float
    context: tuple[str, ...] = ()
    rescore: str | None = None
    gate: str | None = None
    gate_words: tuple[str, ...] = ()
    needs: str | None = None
    ignore_case: bool = True
    lead: str | None = None

    @property
    def flags(self) -> str:
        return "(?Uims)" if self.ignore_case else "(?Ums)"

    @property
    def pattern(self) -> str:
        return self.flags + self.regex

    @property
    def priority(self) -> int:
        """Rank at equal score and length: the more specific UK entities first."""
        return 0 if self.entity.startswith("UK_") else 1


# A valid NHS number gains 0.45 up to 0.95; an invalid one stays only from 0.5 up.
NHS_RESCORE = (f"CASE WHEN {checksums.nhs_valid('{m}')} THEN least({{s}} + 0.45D, 0.95D) "
               "WHEN {s} >= 0.5D THEN {s} END")
UK_IBAN_RESCORE = f"CASE WHEN {checksums.iban_valid('{m}', 22)} THEN {{s}} END"
IBAN_RESCORE = f"CASE WHEN {checksums.iban_valid('{m}')} THEN {{s}} END"
# One permissive pattern finds a run of groups; the test on the run without what leads it decides.
IPV6_LEAD = r"^[^0-9A-Fa-f:]"
IPV6_RESCORE = (f"CASE WHEN {checksums.ipv6_valid(f'regexp_replace({{m}}, {lit(IPV6_LEAD)}, {chr(39) * 2})')} "
                "THEN {s} END")
LUHN_RESCORE = f"CASE WHEN {checksums.luhn_valid('{m}')} THEN {{s}} END"

# Patterns, scores and context words of the UK rules.
NI_CONTEXT = ("national insurance", "ni number", "nino", "ni:", "n.i.")
NHS_CONTEXT = ("nhs number", "nhs no", "patient number", "nhs:", "hospital number")
POSTCODE_CONTEXT = ("postcode", "post code", "postal code", "zip")
PHONE_CONTEXT = ("phone", "telephone", "tel", "mobile", "call", "contact")
LICENCE_CONTEXT = ("driving licence", "driving license", "dvla", "licence number", "driver")
UK_IBAN_CONTEXT = ("iban", "bank account", "sort code", "bacs", "international bank")

UK_RULES = (
    Rule("uk_ni_standard", "UK_NI",
         r"\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", 0.85,
         NI_CONTEXT, gate=DIGIT, needs=r"\d{2}\s?\d{2}\s?\d{2}\s?[A-D]"),
    Rule("uk_nhs_spaced", "UK_NHS", r"\b\d{3}\s\d{3}\s\d{4}\b", 0.5,
         NHS_CONTEXT, NHS_RESCORE, gate=DIGIT, needs=r"\d{3}\s\d{3}\s\d{4}"),
    Rule("uk_nhs_compact", "UK_NHS", r"\b\d{10}\b", 0.3,
         NHS_CONTEXT, NHS_RESCORE, gate=DIGIT, needs=r"\d{10}"),
    Rule("uk_postcode", "UK_POSTCODE",
         r"\b(?:[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-BD-HJLNP-UW-Z]{2}|[A-Z]{1,2}\d[A-Z\d]?)\b", 0.6,
         POSTCODE_CONTEXT, gate=DIGIT, needs=r"\d(?<=[A-Z]\d)"),
    Rule("uk_mobile", "UK_PHONE", r"\b(?:07\d{3}[\s\-]?\d{6}|07\d{9})\b", 0.75,
         PHONE_CONTEXT, gate=DIGIT, needs=r"07\d{3}"),
    Rule("uk_landline", "UK_PHONE",
         r"\b(?:0\d{4}[\s\-]?\d{6}|0\d{3}[\s\-]?\d{7}|0\d{9,10})\b", 0.65,
         PHONE_CONTEXT, gate=DIGIT, needs=r"0\d{3}"),
    Rule("uk_intl", "UK_PHONE",
         r"\b(?:\+44[\s\-]?\d{2,4}[\s\-]?\d{3,4}[\s\-]?\d{3,4})\b", 0.8,
         PHONE_CONTEXT, gate=DIGIT, needs=r"\+44"),
    Rule("uk_driving_licence", "UK_DRIVING_LICENCE",
         r"\b[A-Z]{1,5}\d{6}[A-Z]{2}\d[A-Z]{2}\b", 0.7,
         LICENCE_CONTEXT, gate=DIGIT, needs=r"\d{6}[A-Z]{2}\d"),
    Rule("uk_iban", "UK_IBAN", r"\bGB\d{2}[A-Z]{4}\d{14}\b", 0.8,
         UK_IBAN_CONTEXT, UK_IBAN_RESCORE, gate=DIGIT, needs=r"\d{2}[A-Z]{4}\d{14}"),
    Rule("uk_iban_spaced", "UK_IBAN",
         r"\bGB\d{2}\s?[A-Z]{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2}\b", 0.8,
         UK_IBAN_CONTEXT, UK_IBAN_RESCORE, gate=DIGIT, needs=r"\d{2}\s?[A-Z]{4}\s?\d{4}"),
)

# Generic entities, our own definitions.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
NATIONALITIES = (
    "American", "Australian", "British", "Canadian", "Chinese", "Danish", "Dutch", "English",
    "French", "German", "Greek", "Indian", "Irish", "Italian", "Japanese", "Mexican",
    "Nigerian", "Norwegian", "Pakistani", "Polish", "Portuguese", "Russian", "Scottish",
    "Spanish", "Swedish", "Swiss", "Turkish", "Welsh",
)
RELIGIONS = ("Anglican", "Buddhist", "Catholic", "Christian", "Hindu", "Jewish", "Methodist",
             "Muslim", "Protestant", "Quaker", "Sikh")
POLITICAL = ("Conservative", "Labour", "Liberal", "Republican", "Democrat", "Socialist")
NRP_WORDS = NATIONALITIES + RELIGIONS + POLITICAL
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Dear")
COMPANY_SUFFIXES = ("Ltd", "Limited", "plc", "PLC", "LLP", "Inc")

GENERIC_RULES = (
    Rule("email", "EMAIL_ADDRESS",
         r"\b[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 1.0,
         gate=AT, needs=r"@"),
    Rule("phone_intl", "PHONE_NUMBER",
         r"\+\d{1,3}[ \-]?\(\d{2,4}\)[ \-]?\d{3,4}[ \-]?\d{4}\b", 0.4,
         PHONE_CONTEXT, gate=DIGIT, needs=r"\+\d"),
    Rule("card", "CREDIT_CARD", r"\b\d(?:[ \-]?\d){12,18}\b", 1.0,
         rescore=LUHN_RESCORE, gate=DIGIT, needs=r"\d(?:[ \-]?\d){12}"),
    Rule("iban_compact", "IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 1.0,
         rescore=IBAN_RESCORE, gate=DIGIT, needs=r"\d{2}[A-Z0-9]{11}", ignore_case=False),
    Rule("iban_spaced", "IBAN_CODE",
         r"\b[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?\b", 1.0,
         rescore=IBAN_RESCORE, gate=DIGIT, needs=r"\d{2} [A-Z0-9]{4} ", ignore_case=False),
    Rule("ipv4", "IP_ADDRESS",
         r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
         r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b", 0.6,
         gate=DIGIT, needs=r"\d\.\d{1,3}\.\d"),
    Rule("ipv6", "IP_ADDRESS",
         r"(?:^|[^0-9A-Za-z:.])[0-9A-F:]*(?:::\B|:[0-9A-F]{1,4}(?:\.[0-9]{1,3}){3}\b|:[0-9A-F]{1,4}\b)", 0.6,
         rescore=IPV6_RESCORE, gate=COLON, needs=r":[0-9A-F]{0,4}:", lead=IPV6_LEAD),
    Rule("date_iso", "DATE_TIME", r"\b\d{4}-\d{2}-\d{2}\b", 0.6,
         gate=DIGIT, needs=r"\d{4}-\d{2}-\d{2}"),
    Rule("date_numeric", "DATE_TIME", r"\b\d{1,2}[/.]\d{1,2}[/.]\d{4}\b", 0.6,
         gate=DIGIT, needs=r"\d[/.]\d{1,2}[/.]\d{4}"),
    Rule("date_words", "DATE_TIME", rf"\b\d{{1,2}} (?:{MONTHS}) \d{{4}}\b", 0.6,
         gate=DIGIT, needs=rf"\d (?:{MONTHS})"),
    Rule("title_name", "PERSON",
         rf"\b(?:{'|'.join(TITLES)})\.?[ \t]+\p{{Lu}}[\p{{L}}'\-]*"
         r"(?:[ \t]+\p{Lu}[\p{L}'\-]*){0,2}\b", 0.85,
         gate_words=TITLES, needs=rf"{initials(TITLES)}\b(?:{'|'.join(TITLES)})\.?[ \t]",
         ignore_case=False, lead=rf"^(?:{'|'.join(TITLES)})\.?[ \t]+"),
    Rule("nrp_word", "NRP", rf"\b(?:{'|'.join(NRP_WORDS)})s?\b", 0.85, ignore_case=False,
         gate_words=NRP_WORDS, needs=rf"{initials(NRP_WORDS)}\b(?:{'|'.join(NRP_WORDS)})s?\b"),
    Rule("company_suffix", "ORGANIZATION",
         rf"\b\p{{Lu}}[\p{{L}}&'\-]*(?:[ \t]+\p{{Lu}}[\p{{L}}&'\-]*){{0,3}}[ \t]+"
         rf"(?:{'|'.join(COMPANY_SUFFIXES)})\b", 0.85, gate_words=COMPANY_SUFFIXES,
         needs=rf"[ \t](?:{'|'.join(COMPANY_SUFFIXES)})\b", ignore_case=False),
)

# A leading "+" is never after a word boundary unless a letter precedes it, so uk_intl misses
# the usual " +44 …". This rule finds it; it is off unless passed explicitly.
UK_INTL_LEAD = Rule(
    "uk_intl_lead", "UK_PHONE",
    r"\+44[\s\-]?\d{2,4}[\s\-]?\d{3,4}[\s\-]?\d{3,4}\b", 0.8, PHONE_CONTEXT,
         gate=DIGIT, needs=r"\+44")

_registered: list[Rule] = []


def register_rule(rule: Rule) -> None:
    """Add a rule to the defaults of this Python process."""
    if any(r.name == rule.name for r in default_rules()):
        raise ValueError(f"rule {rule.name!r} exists already")
    _registered.append(rule)


def unregister_rule(name: str) -> None:
    _registered[:] = [r for r in _registered if r.name != name]


def default_rules(entities: Iterable[str] | None = None) -> tuple[Rule, ...]:
    """All rules, or only those of ``entities``; others are not even planned."""
    rules = UK_RULES + GENERIC_RULES + tuple(_registered)
    if entities is None:
        return rules
    wanted = set(entities)
    return tuple(r for r in rules if r.entity in wanted)


def parse_entities(spec: str | None) -> list[str] | None:
    """``"UK_NI, PERSON"`` → list; None or an empty text means all entities."""
    if spec is None or not spec.strip():
        return None
    return [e.strip().upper() for e in spec.split(",") if e.strip()]
