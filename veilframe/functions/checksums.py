"""Checksum predicates on matched strings, as SQL expressions."""

from __future__ import annotations

import sys
import unicodedata

from veilframe.functions.arrays import let, lit, var

# Decimal digits of all scripts, which a Unicode digit class matches, and their values.
_FOREIGN = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _FOREIGN)


def digits_of(value: str) -> str:
    """Only the decimal digits of ``value``, as ASCII."""
    plain = f"translate({value}, '{_FOREIGN}', '{_VALUES}')"
    ascii_form = f"IF(octet_length({value}) = length({value}), {value}, {plain})"
    return f"regexp_replace({ascii_form}, '[^0-9]', '')"


def digit_at(digits: str, i: int | str) -> str:
    return f"cast(substring({digits}, {i}, 1) AS int)"


def nhs_check_digit(nine: str) -> str:
    """Modulus-11 check value of nine digits; 10 means that no valid digit exists."""
    total = " + ".join(f"{digit_at(nine, i)} * {11 - i}" for i in range(1, 10))
    return f"((11 - ({total}) % 11) % 11)"


def nhs_valid(value: str) -> str:
    return let(digits_of(value), lambda d: f"CASE WHEN length({d}) = 10 THEN "
               f"{nhs_check_digit(d)} = {digit_at(d, 10)} ELSE false END")


def mod97(chars: str) -> str:
    """Remainder by 97 of a string of digits and capital letters (A = 10 … Z = 35)."""
    acc, ch = var("acc"), var("ch")
    return (f"aggregate(split({chars}, ''), 0, ({acc}, {ch}) -> CASE WHEN {ch} = '' THEN {acc} "
            f"WHEN ascii({ch}) < 58 THEN ({acc} * 10 + ascii({ch}) - 48) % 97 "
            f"ELSE ({acc} * 100 + ascii({ch}) - 55) % 97 END)")


def iban_valid(value: str, length: int | None = None) -> str:
    """ISO 13616 check: rotate four characters to the end, remainder by 97 is 1."""
    def check(s: str) -> str:
        shape = f"{s} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$'"
        if length is not None:
            shape += f" AND length({s}) = {length}"
        rotated = f"concat(substring({s}, 5), left({s}, 4))"
        return f"CASE WHEN {shape} THEN {mod97(rotated)} = 1 ELSE false END"

    return let(f"upper(replace({value}, ' ', ''))", check)


def luhn_sum(digits: str) -> str:
    """Luhn sum; every second digit from the right is doubled."""
    d, i, a, x = var("d"), var("i"), var("a"), var("x")
    n = f"cast({d} AS int)"
    terms = (f"transform(filter(split(reverse({digits}), ''), {d} -> {d} != ''), ({d}, {i}) -> "
             f"CASE WHEN {i} % 2 = 0 THEN {n} WHEN {n} > 4 THEN {n} * 2 - 9 ELSE {n} * 2 END)")
    return f"aggregate({terms}, 0, ({a}, {x}) -> {a} + {x})"


def luhn_valid(value: str) -> str:
    return let(digits_of(value), lambda d: f"CASE WHEN length({d}) BETWEEN 12 AND 19 THEN "
               f"{luhn_sum(d)} % 10 = 0 ELSE false END")


def hex_hash(value: str) -> str:
    return f"sha2(encode({value}, {lit('UTF-8')}), 256)"


# Groups of an IPv4 address at the end of an IPv6 one.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_TAIL = rf"(?:{_OCTET}\.){{3}}{_OCTET}$"


def ipv6_tests(address: str, like, replace, groups) -> str:
    """SQL test of a run of hexadecimal digits, colons and dots, in the words of an engine.

    ``like(x, regex)``, ``replace(x, regex, text)`` and ``groups(x)``, the number of non-empty parts
    between colons, are given. An IPv4 tail counts as two groups. At most one pair of colons stands
    for missing groups; without it there are eight, with it at most seven.
    """
    plain = replace(address, f":{IPV4_TAIL}", ":0:0")
    wrong = (r":::", r"::.*::", r"^:[^:]", r"[^:]:$", r"[0-9A-Fa-f]{5}", r"\.")
    fits = " AND ".join(f"NOT {like(plain, w)}" for w in wrong)
    many = f"CASE WHEN {like(plain, '::')} THEN {groups(plain)} <= 7 ELSE {groups(plain)} = 8 END"
    return f"({fits} AND {many})"


def ipv6_valid(address: str) -> str:
    x = var("x")
    return let(address, lambda a: ipv6_tests(
        a, lambda v, rx: f"{v} RLIKE {lit(rx)}", lambda v, rx, new: f"regexp_replace({v}, {lit(rx)}, {lit(new)})",
        lambda v: f"size(filter(split({v}, ':'), {x} -> {x} != ''))"))
