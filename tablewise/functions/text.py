"""Text expressions built from Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's (?U) makes \s cover Unicode whitespace; the four separators 0x1c-0x1f
# count as whitespace for text readers too.
_EDGE_SPACE = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
_LETTER_RUNS = r"(\p{L}+|[^\p{L}]+)"


def strip_edges(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def title_case(c: Column) -> Column:
    """Capital letter after every non-letter, the rest lower ("They'Re Abc-Def")."""
    runs = F.regexp_extract_all(c, F.lit(_LETTER_RUNS), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def change_case(c: Column, case: str) -> Column:
    return {"lower": F.lower, "upper": F.upper, "title": title_case}[case](c)


def lexical_class(c: Column) -> Column:
    """integer / decimal / boolean / text, judged by the whole trimmed value."""
    t = F.trim(c)
    numeric = (
        F.when(t.rlike(r"^[+-]?[0-9]+$"), F.lit("integer"))
        .when(
            t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
            F.lit("decimal"),
        )
        .otherwise(F.lit("text"))
    )
    # Most texts hold no digit and need none of the number patterns.
    return (
        F.when(c.rlike("[0-9]"), numeric)
        .when(F.lower(t).isin("true", "false"), F.lit("boolean"))
        .otherwise(F.lit("text"))
    )


LEXICAL_CLASSES = ("integer", "decimal", "boolean", "text")
