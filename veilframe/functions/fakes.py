"""Fake values as a pure function of a hash, as SQL expressions.

``h`` is a 64-digit hex string, normally ``sha2(salt || original_hash)``. The same hash
always gives the same fake, on any executor and in any order of rows.
"""

from __future__ import annotations

from veilframe.functions import checksums as C
from veilframe.functions.arrays import let, lit

# Pools of names and words.
FIRST_NAMES = (
    "Aisha", "Alan", "Amelia", "Arthur", "Beth", "Callum", "Carol", "Charlotte", "Daniel",
    "Diane", "Edward", "Eleanor", "Fiona", "Gareth", "George", "Grace", "Hannah", "Harry",
    "Imran", "Isla", "Jack", "Jasmine", "Karen", "Kieran", "Leah", "Liam", "Maya", "Nathan",
    "Olivia", "Owen", "Priya", "Rhys", "Rosie", "Samir", "Sophie", "Thomas",
)
LAST_NAMES = (
    "Adams", "Allen", "Bailey", "Barker", "Bennett", "Brooks", "Carter", "Clarke", "Cooper",
    "Davies", "Dixon", "Edwards", "Ellis", "Fletcher", "Foster", "Gibson", "Graham", "Harris",
    "Hughes", "Jenkins", "Kaur", "Knight", "Lawson", "Marsh", "Mason", "Norris", "Osborne",
    "Palmer", "Patel", "Quinn", "Reid", "Shaw", "Turner", "Vaughan", "Walsh", "Wright",
)
# Surnames and places are composed of three parts, so that many values find plain fakes.
HEADS = (
    "Ald", "Ash", "Bar", "Beck", "Ben", "Brad", "Bram", "Bur", "Carl", "Chal", "Cor", "Cran",
    "Dal", "Den", "Dun", "Ed", "Elm", "Fair", "Farn", "Gar", "Glen", "Hal", "Harl", "Hart",
    "Hol", "Kel", "Ken", "Lang", "Lin", "Marl", "Mel", "Mor", "Nor", "Oak", "Pem", "Pres",
    "Ral", "Red", "Ros", "Sel", "Stan", "Strat", "Thorn", "Tor", "Wal", "Wes", "Wil", "Win",
)
MIDDLES = ("", "a", "ber", "den", "der", "e", "en", "er", "for", "i", "ing", "ken", "ling", "man",
           "mer", "ner", "o", "ren", "ring", "sen", "ter", "ton", "ver", "wen")
ENDINGS = ("ley", "ton", "ford", "wick", "well", "ham", "son", "man", "field", "worth", "stone", "more",
           "by", "den", "ridge", "stead", "wood", "brook", "land", "dale", "grove", "mont",
           "croft", "ster")
PLACE_ENDINGS = ("bury", "borough", "minster", "mouth", "haven", "bridge", "chester", "hampton", "ford",
                 "stead", "thorpe", "wick", "combe", "dale", "leigh", "market")
PLACE_KINDS = ("", "Great ", "Little ", "Upper ", "Lower ", "North ", "South ", "Old ")
COMPANY_ENDINGS = ("Ltd", "plc", "LLP", "Group", "and Sons")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NI_PREFIX_LETTERS = "ABCEGHJKLMNOPRSTW"
NI_SUFFIX_LETTERS = "ABCD"
POSTCODE_INWARD_LETTERS = "ABDEFGHJLNPQRSTUWXYZ"
BIRTH_START, BIRTH_DAYS = "1940-01-01", 25_000


def word(h: str, k: int) -> str:
    """The k-th of eight 32-bit numbers of the hash, 0 to 7."""
    return f"cast(conv(substring({h}, {8 * k + 1}, 8), 16, 10) AS bigint)"


def byte(h: str, k: int) -> str:
    """The k-th byte of the hash, 0 to 31."""
    return f"cast(conv(substring({h}, {2 * k + 1}, 2), 16, 10) AS int)"


def pick(pool: tuple[str, ...], number: str) -> str:
    items = ", ".join(lit(p) for p in pool)
    return f"element_at(array({items}), cast({number} % {len(pool)} AS int) + 1)"


def letter(alphabet: str, number: str) -> str:
    return f"substring('{alphabet}', cast({number} % {len(alphabet)} AS int) + 1, 1)"


def digits(number: str, n: int) -> str:
    return f"lpad(cast({number} % {10 ** n} AS string), {n}, '0')"


def composed(number: str, *pools: tuple[str, ...]) -> str:
    """One part of each pool, all chosen by one number."""
    parts, below = [], 1
    for pool in pools:
        parts.append(pick(pool, f"({number} div {below})"))
        below *= len(pool)
    return f"concat({', '.join(parts)})"


def surname(number: str) -> str:
    return composed(number, HEADS, MIDDLES, ENDINGS)


def person(h: str) -> str:
    """First name, middle name and surname: 36 * 36 * 27,648 different ones."""
    return (f"concat({pick(FIRST_NAMES, word(h, 0))}, ' ', {pick(FIRST_NAMES, word(h, 3))}, ' ', "
            f"{surname(word(h, 1))})")


def company(h: str) -> str:
    return (f"concat({surname(word(h, 0))}, ' ', {surname(word(h, 1))}, ' ', "
            f"{pick(COMPANY_ENDINGS, word(h, 2))})")


def place(h: str) -> str:
    """147,456 different ones, none of which is meant to exist."""
    return composed(word(h, 0), PLACE_KINDS, HEADS, MIDDLES, PLACE_ENDINGS)


def email(h: str) -> str:
    return (f"concat(lower({pick(FIRST_NAMES, word(h, 0))}), '.', "
            f"lower({pick(LAST_NAMES, word(h, 1))}), {digits(word(h, 2), 6)}, '@example.com')")


def phone(h: str) -> str:
    return f"concat('07700 9', {digits(word(h, 0), 5)})"


def postcode(h: str) -> str:
    return (f"concat({letter(LETTERS, byte(h, 0))}, {letter(LETTERS, byte(h, 1))}, "
            f"{digits(byte(h, 2), 1)}, ' ', {digits(byte(h, 3), 1)}, "
            f"{letter(POSTCODE_INWARD_LETTERS, byte(h, 4))}, "
            f"{letter(POSTCODE_INWARD_LETTERS, byte(h, 5))})")


def birth_date(h: str, k: int = 0) -> str:
    return f"date_add(DATE'{BIRTH_START}', cast({word(h, k)} % {BIRTH_DAYS} AS int))"


def date(h: str) -> str:
    return f"cast({birth_date(h)} AS string)"


def iban(h: str) -> str:
    bank = "concat(" + ", ".join(letter(LETTERS, byte(h, k)) for k in range(4)) + ")"
    bban = f"concat({bank}, {digits(word(h, 1), 7)}, {digits(word(h, 2), 7)})"
    return let(bban, lambda b: (
        f"concat('GB', lpad(cast(98 - {C.mod97(f"concat({b}, 'GB00')")} "
        f"AS string), 2, '0'), {b})"))


def card(h: str) -> str:
    body = f"concat('4', {digits(word(h, 0), 7)}, {digits(word(h, 1), 7)})"
    return let(body, lambda b: (
        f"concat({b}, cast((10 - {C.luhn_sum(f"concat({b}, '0')")} % 10) % 10 AS string))"))


def ip(h: str) -> str:
    return "concat_ws('.', " + ", ".join(byte(h, k) for k in range(4)) + ")"


def nrp(h: str) -> str:
    three = ", ".join(letter(LETTERS, byte(h, k)) for k in range(3))
    return f"concat({three}, '-', {digits(word(h, 1), 4)})"


def ni(h: str) -> str:
    return (f"concat({letter(NI_PREFIX_LETTERS, byte(h, 0))}, "
            f"{letter(NI_PREFIX_LETTERS, byte(h, 1))}, {digits(word(h, 1), 6)}, "
            f"{letter(NI_SUFFIX_LETTERS, byte(h, 2))})")


def nhs(h: str) -> str:
    """Where no check digit exists the ninth digit moves up by one, which always helps."""
    def checked(nine: str) -> str:
        return (f"concat(left({nine}, 3), ' ', substring({nine}, 4, 3), ' ', "
                f"substring({nine}, 7, 3), cast({C.nhs_check_digit(nine)} AS string))")

    def mended(nine: str) -> str:
        moved = f"cast(({C.digit_at(nine, 9)} + 1) % 10 AS string)"
        return f"IF({C.nhs_check_digit(nine)} = 10, concat(left({nine}, 8), {moved}), {nine})"

    return let(digits(word(h, 0), 9), lambda n: let(mended(n), checked))


def driving_licence(h: str) -> str:
    surname = f"rpad(upper(left({pick(LAST_NAMES, word(h, 0))}, 5)), 5, 'X')"

    def composed(d: str) -> str:
        return (f"concat({surname}, substring({d}, 3, 1), substring({d}, 6, 1), "
                f"substring({d}, 4, 1), substring({d}, 7, 1), substring({d}, 9, 2), "
                f"{letter(LETTERS, byte(h, 8))}, {letter(LETTERS, byte(h, 9))}, '9', "
                f"{letter(LETTERS, byte(h, 10))}, {letter(LETTERS, byte(h, 11))})")

    return let(f"cast({birth_date(h, 1)} AS string)", composed)


GENERATORS = {
    "PERSON": person, "ORGANIZATION": company, "LOCATION": place, "EMAIL_ADDRESS": email,
    "PHONE_NUMBER": phone, "UK_PHONE": phone, "UK_POSTCODE": postcode, "DATE_TIME": date,
    "IBAN_CODE": iban, "UK_IBAN": iban, "CREDIT_CARD": card, "IP_ADDRESS": ip, "NRP": nrp,
    "UK_NI": ni, "UK_NHS": nhs, "UK_DRIVING_LICENCE": driving_licence,
}


def fake_value(entity: str, h: str) -> str:
    """Fake of the given entity column; an unknown entity gives ``[ENTITY_FAKE]``."""
    cases = " ".join(f"WHEN {lit(e)} THEN {make(h)}" for e, make in GENERATORS.items())
    return f"CASE {entity} {cases} ELSE concat('[', {entity}, '_FAKE]') END"


def seeded(salt: str, value_hash: str, attempt: str = "0") -> str:
    """The hash a fake is made from; a later attempt gives an unrelated one."""
    return (f"sha2(encode(concat({salt}, {value_hash}, IF({attempt} = 0, '', "
            f"concat('#', {attempt}))), 'UTF-8'), 256)")
