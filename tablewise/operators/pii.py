"""Find, summarise, mask and scrub personal data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions import masking
from tablewise.functions.columns import (
    as_text,
    melt,
    name_of,
    quoted,
    replace_columns,
    require_columns,
)
from tablewise.functions.patterns import (
    LOW_CONFIDENCE,
    MIN_HIT_RATIO,
    MIN_HIT_RATIO_LOW_CONFIDENCE,
    MIN_PRESENT_RATIO,
    PATTERNS,
    header_hint,
    java_regex,
    may_match,
)

METHODS = ("synthetic", "hash", "redact")
DEFAULT_SALT = "tablewise"


def pii_hits(df: DataFrame) -> DataFrame:
    """(i, column, n_rows, present, <category> hit counts): one scan of all values."""
    names = df.columns
    cells = melt(df, [(as_text(df, c),) for c in names], ["v"], keep_nulls=True)
    v = F.col("v")
    # The cheap tests become columns, so that each runs once per cell.
    tested = cells.withColumns({"digit": may_match(v, "mobile"), "at": may_match(v, "email")})
    hits = {
        k: F.col("at" if k == "email" else "digit") & v.rlike(java_regex(k)) for k in PATTERNS
    }
    ordinal = F.col("i").cast("int")
    return (
        tested.groupBy("i")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("v").alias("present"),
            *[F.count_if(hit).alias(k) for k, hit in hits.items()],
        )
        .withColumns({"i": ordinal, "column": name_of(names, ordinal)})
    )


def detect_pii(df: DataFrame, min_hit_ratio: float = MIN_HIT_RATIO) -> DataFrame:
    """(column, categories): the header's hint first, then matchers that hit enough.

    Every value is scanned.  A matcher counts from ``min_hit_ratio`` of the present
    values on (half of them for the low-confidence postal code); columns present in
    under 1 % of rows go by header only.
    """
    hints = F.array(
        *[F.lit(header_hint(c)).cast("string") for c in df.columns]
    )
    hint = F.get(hints, F.col("i"))
    scanned = F.col("present") / F.col("n_rows") >= MIN_PRESENT_RATIO
    found = []
    for k in PATTERNS:
        least = MIN_HIT_RATIO_LOW_CONFIDENCE if k in LOW_CONFIDENCE else min_hit_ratio
        enough = scanned & (F.col("present") > 0) & (F.col(k) / F.col("present") >= least)
        found.append(F.when(enough, F.lit(k)))
    categories = F.array_distinct(F.array_compact(F.array(hint, *found)))
    return (
        pii_hits(df)
        .where("n_rows > 0")
        .select("column", categories.alias("categories"))
        .where(F.size("categories") > 0)
    )


def pii_plan(df: DataFrame) -> dict[str, list[str]]:
    """The detections as {column: categories}, at most one entry per column."""
    return {r["column"]: list(r["categories"]) for r in detect_pii(df).collect()}


def pii_summary(df: DataFrame) -> DataFrame:
    """(category, n_columns), plus the number of personal columns as '(any)'."""
    found = detect_pii(df).select(
        F.explode(F.concat(F.array(F.lit("(any)")), "categories")).alias("category")
    )
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n_columns"))


def mask_value(
    c: Column, category: str, method: str, seed: int = 42, salt: str = DEFAULT_SALT
) -> Column:
    if method == "hash":
        return masking.hash_value(c, salt)
    if method == "redact":
        return masking.redact_value(c, category)
    return masking.synthetic_value(c, category, seed)


def mask_pii(
    df: DataFrame,
    plan: dict[str, list[str]],
    method: str = "synthetic",
    seed: int = 42,
    salt: str = DEFAULT_SALT,
) -> DataFrame:
    """Rewrite the planned columns; the first category of a column picks its mask.

    Row-local and lazy, so it also runs on streams.  Missing cells stay missing.
    """
    if method not in METHODS:
        raise ValueError(f"unknown masking method {method!r}; use one of {METHODS}")
    require_columns(df, plan)
    exprs = {
        c: mask_value(as_text(df, c), categories[0], method, seed, salt)
        for c, categories in plan.items()
        if categories
    }
    return replace_columns(df, exprs)


def scrub_columns(
    df: DataFrame,
    plan: dict[str, list[str]] | None = None,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Every cell as text with personal data replaced by placeholders.

    Columns to ``keep`` stay as they are: a key of six digits reads like a postal code.
    """
    plan, keep = plan or {}, set(keep)
    require_columns(df, [*plan, *keep])
    return df.select(
        *[
            quoted(c) if c in keep
            else masking.scrub_text(as_text(df, c), plan.get(c, [])).alias(c)
            for c in df.columns
        ]
    )
