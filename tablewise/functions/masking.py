"""Mask, redact and scrub expressions for personal data (Columns only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewise.functions.patterns import (
    PATTERNS,
    PLACEHOLDERS,
    WHOLE_CELL,
    java_regex,
    may_match,
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
PAN_ENTITY = "PCHFATBLJG"  # fixed value: allowed 4th letters of a PAN


# ------------------------------------------------------------------ hashing

def hash_value(c: Column, salt: str) -> Column:
    """First ten hex characters of SHA-256 over ``salt:value``."""
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), c), 256), 1, 10)


# ---------------------------------------------------------------- redaction

def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def _left(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def _right(c: Column, n: int) -> Column:
    return F.substring(c, -n, n)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def _redact_email(c: Column) -> Column:
    at = F.instr(c, "@")
    head = F.when(at > 2, F.concat(_left(c, 1), F.lit("***"))).otherwise(F.lit("***"))
    return F.when(at == 0, F.lit("***")).otherwise(
        F.concat(head, c.substr(at, F.length(c)))
    )


def _redact_name(c: Column) -> Column:
    words = F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    masked = F.array_join(
        F.transform(words, lambda w: F.concat(_left(w, 1), F.lit("***"))), " "
    )
    return F.when(F.size(words) == 0, F.lit("***")).otherwise(masked)


def redact_value(c: Column, category: str) -> Column:
    """Partial mask that keeps the visible shape of the value."""
    n = F.length(c)
    d = _digits(c)
    hidden = _stars(n)
    if category == "email":
        out = _redact_email(c)
    elif category == "pan":
        out = F.when(n == 10, F.concat(_left(c, 5), F.lit("****"), _right(c, 1)))
    elif category == "mobile":
        last = _right(d, 10)
        out = F.when(
            F.length(d) >= 10, F.concat(_left(last, 2), F.lit("******"), _right(last, 2))
        )
    elif category == "aadhaar":
        out = F.when(F.length(d) == 12, F.concat(F.lit("XXXX-XXXX-"), _right(d, 4)))
    elif category == "credit_card":
        out = F.when(
            F.length(d) >= 13, F.concat(_stars(F.length(d) - 4), _right(d, 4))
        )
    elif category == "gstin":
        out = F.when(
            n == 15,
            F.concat(_left(c, 2), F.lit("*****"), F.substring(c, 8, 4), F.lit("***")),
        )
    elif category == "ifsc":
        out = F.when(n == 11, F.concat(_left(c, 4), F.lit("0******")))
    elif category == "pincode":
        out = F.when(F.length(d) == 6, F.concat(_left(d, 2), F.lit("****")))
    elif category == "name":
        out = _redact_name(c)
    elif category == "address":
        out = F.when(n > 4, F.concat(_left(c, 3), _stars(n - 3)))
    else:
        out = F.when(n > 2, F.concat(_left(c, 1), _stars(n - 2), _right(c, 1)))
    return F.when(n == 0, c).otherwise(F.coalesce(out, hidden))


# ---------------------------------------------------------------- synthetic

# Small invented word lists for readable fakes.
FIRST_NAMES = (
    "Aarav", "Aditi", "Anika", "Arjun", "Bhavna", "Chetan", "Deepa", "Farhan", "Gauri",
    "Harsh", "Isha", "Jatin", "Kavya", "Lakshmi", "Manish", "Neha", "Omkar", "Pooja",
    "Rahul", "Sana", "Tara", "Uday", "Vikram", "Zoya",
)
LAST_NAMES = (
    "Agarwal", "Bose", "Chopra", "Das", "Gill", "Iyer", "Joshi", "Kapoor", "Lal", "Mehta",
    "Nair", "Patel", "Rao", "Saxena", "Thakur", "Verma",
)
STREETS = (
    "Lake Road", "Station Road", "Temple Street", "Garden Lane", "Hill View", "Market Road",
    "Park Avenue", "River Bank", "School Lane", "Fort Road",
)
CITIES = (
    "Agra", "Bhopal", "Chennai", "Delhi", "Indore", "Jaipur", "Kochi", "Lucknow", "Mumbai",
    "Nagpur", "Pune", "Surat",
)
MAIL_DOMAINS = ("example.com", "example.net", "example.org")


class _Draws:
    """Repeatable draws from (value, seed, category): equal inputs give equal fakes."""

    def __init__(self, c: Column, category: str, seed: int):
        self.c, self.category, self.seed, self.slot = c, category, seed, 0

    def below(self, n: int) -> Column:
        self.slot += 1
        label = F.lit(f"{self.category}/{self.slot}")
        return F.pmod(F.xxhash64(F.lit(self.seed), label, self.c), F.lit(n)).cast("int")

    def char(self, alphabet: str) -> Column:
        return F.lit(alphabet).substr(self.below(len(alphabet)) + 1, F.lit(1))

    def chars(self, alphabet: str, n: int) -> list[Column]:
        return [self.char(alphabet) for _ in range(n)]

    def number(self, first: str, rest: int) -> Column:
        """A leading digit out of ``first`` followed by ``rest`` free digits."""
        tail = F.lpad(self.below(10 ** min(rest, 9)).cast("string"), min(rest, 9), "0")
        parts = [self.char(first), tail]
        if rest > 9:
            parts.append(
                F.lpad(self.below(10 ** (rest - 9)).cast("string"), rest - 9, "0")
            )
        return F.concat(*parts)

    def word(self, words: tuple[str, ...]) -> Column:
        return F.get(F.array(*[F.lit(w) for w in words]), self.below(len(words)))


def synthetic_value(c: Column, category: str, seed: int) -> Column:
    """Format-preserving fake; the same input always maps to the same output."""
    draw = _Draws(c, category, seed)
    alnum = UPPER + DIGITS
    if category == "email":
        made = F.concat(
            F.lower(draw.word(FIRST_NAMES)), F.lit("."), F.lower(draw.word(LAST_NAMES)),
            F.lpad(draw.below(1_000_000_000).cast("string"), 9, "0"), F.lit("@"),
            draw.word(MAIL_DOMAINS),
        )
    elif category == "mobile":
        made = draw.number("6789", 9)
    elif category == "aadhaar":
        made = draw.number("23456789", 11)
    elif category == "credit_card":
        made = draw.number("3456", 15)
    elif category == "pincode":
        made = draw.number("123456789", 5)
    elif category == "pan":
        made = F.concat(
            *draw.chars(UPPER, 3), draw.char(PAN_ENTITY), draw.char(UPPER),
            *draw.chars(DIGITS, 4), draw.char(UPPER),
        )
    elif category == "gstin":
        made = F.concat(
            (draw.below(28) + 10).cast("string"), *draw.chars(UPPER, 5),
            *draw.chars(DIGITS, 4), draw.char(UPPER), draw.char(alnum), F.lit("Z"),
            draw.char(alnum),
        )
    elif category == "ifsc":
        made = F.concat(*draw.chars(UPPER, 4), F.lit("0"), *draw.chars(alnum, 6))
    elif category == "name":
        made = F.concat_ws(" ", draw.word(FIRST_NAMES), draw.word(LAST_NAMES))
    elif category == "address":
        made = F.concat(
            (draw.below(999) + 1).cast("string"), F.lit(" "), draw.word(STREETS),
            F.lit(", "), draw.word(CITIES), F.lit(" "), draw.number("123456789", 5),
        )
    else:
        made = F.concat(*draw.chars(UPPER + UPPER.lower(), 10))
    return F.when(c.isNotNull(), made)


# ---------------------------------------------------------------- scrubbing

def scrub_text(c: Column, categories: list[str] | None = None) -> Column:
    """Replace personal data inside free text by placeholders.

    The listed categories go first, then every matcher in order as a sweep.  A
    whole-cell category (name, address) replaces any non-empty cell outright.
    """
    categories = categories or []
    for category in categories:
        if category in WHOLE_CELL:
            return F.when(F.length(c) > 0, F.lit(PLACEHOLDERS[category])).otherwise(c)
    order = [x for x in categories if x in PATTERNS] + list(PATTERNS)

    def replaced(kinds: list[str]) -> Column:
        out = c
        for kind in kinds:
            out = F.regexp_replace(out, java_regex(kind), PLACEHOLDERS[kind])
        return out

    # Texts without a digit or an "@" skip the matchers that need one: replacing never
    # brings either in.
    digits = [x for x in order if x != "email"]
    mails = [x for x in order if x == "email"]
    has_digit, has_at = may_match(c, "mobile"), may_match(c, "email")
    return (
        F.when(has_digit & has_at, replaced(order))
        .when(has_digit, replaced(digits))
        .when(has_at, replaced(mails))
        .otherwise(c)
    )
