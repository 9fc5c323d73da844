"""Date text: a list of known layouts, each turned into an ISO timestamp cast.

Every layout is a (pattern, ISO rewrite) pair followed by ``try_cast`` to a
zone-free timestamp.  That keeps parsing out of the session time zone, never
throws, and skips the formatter for values of the wrong shape.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


@dataclass(frozen=True)
class DateLayout:
    """A layout is rewritten by ``iso`` or, with a named month, from its three groups."""

    name: str
    pattern: str
    iso: str = ""
    day_month_year: tuple[int, int, int] | None = None

    def parse(self, c: Column) -> Column:
        """Timestamp without zone, or null where the value is not of this layout."""
        t = F.trim(c)
        if self.day_month_year:
            d, m, y = (F.regexp_extract(t, self.pattern, g) for g in self.day_month_year)
            # Month names start at position 1, 4, 7 ...; anything else is no month.
            at = F.instr(F.lit(_MONTHS), F.lower(F.substring(m, 1, 3)))
            month = F.when(at % 3 == 1, F.floor((at + 2) / 3).cast("string"))
            short = F.when(y < "69", F.concat(F.lit("20"), y)).otherwise(
                F.concat(F.lit("19"), y)
            )
            year = F.when(F.length(y) == 2, short).otherwise(y)
            iso = F.concat(year, F.lit("-"), month, F.lit("-"), d)
        else:
            iso = F.regexp_replace(t, self.pattern, self.iso)
        return F.when(t.rlike(self.pattern), iso.try_cast("timestamp_ntz"))


# Order matters: the first layout wins when two explain equally many values.
LAYOUTS: tuple[DateLayout, ...] = (
    DateLayout("yyyy-MM-dd", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
    DateLayout(
        "yyyy-MM-dd HH:mm[:ss]",
        r"^(\d{4}-\d{1,2}-\d{1,2})[ T](\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)$",
        "$1 $2",
    ),
    DateLayout("dd/MM/yyyy", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1"),
    DateLayout("MM/dd/yyyy", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    DateLayout("dd-MM-yyyy", r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
    DateLayout("yyyy/MM/dd", r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
    DateLayout("dd.MM.yyyy", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1"),
    DateLayout(
        "dd MMM yyyy",
        r"^(\d{1,2})[ -]([A-Za-z]{3,9})[ -](\d{4})$",
        day_month_year=(1, 2, 3),
    ),
    DateLayout(
        "MMMM dd, yyyy",
        r"^([A-Za-z]{3,9}) (\d{1,2}), (\d{4})$",
        day_month_year=(2, 1, 3),
    ),
    DateLayout(
        "dd-MMM-yy",
        r"^(\d{1,2})[ -]([A-Za-z]{3})[ -](\d{2})$",
        day_month_year=(1, 2, 3),
    ),
)

# Full-match shape of values that are promoted to timestamps on load.
ISO_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?\s*$"


def parse_iso(c: Column) -> Column:
    return F.when(c.rlike(ISO_SHAPE), F.trim(c).try_cast("timestamp_ntz"))


# strftime directive -> Spark pattern letters (fixed values).
_DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%j": "DDD",
}


def spark_pattern(fmt: str) -> str:
    """Translate a strftime pattern; a pattern without ``%`` is taken as Spark's own."""
    if "%" not in fmt:
        return fmt
    out, i = "", 0
    while i < len(fmt):
        two = fmt[i : i + 2]
        if two in _DIRECTIVES:
            out, i = out + _DIRECTIVES[two], i + 2
        elif two == "%%":
            out, i = out + "%", i + 2
        elif fmt[i] == "%":
            raise ValueError(f"unsupported date directive {two!r} in {fmt!r}")
        else:
            out, i = out + (f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]), i + 1
    return out


def parse_pattern(c: Column, fmt: str) -> Column:
    """Parse with one explicit pattern; null where it does not fit."""
    pattern = F.lit(spark_pattern(fmt))
    return F.try_to_timestamp(c.cast("string"), pattern).cast("timestamp_ntz")
