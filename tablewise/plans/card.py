"""The dataset card: a short, scrubbed Markdown description of a table.

Every section is a small DataFrame (section, ordinal, text); rendering collects the
finished lines, whose number depends on the schema, not on the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions import masking
from tablewise.functions.columns import (
    as_text,
    missing,
    name_of,
    numeric_columns,
    quoted,
    type_label,
    wide_to_long,
)
from tablewise.operators import correlate, health, pii, profile

MAX_TOKENS = 4000
CHARS_PER_TOKEN = 4
WORST_COLUMNS = 20
SCRUBBED_CHARS = 14_000


def estimate_tokens(text: str) -> int:
    return max(1, len(text) // CHARS_PER_TOKEN) if text else 0


def _line(section: str, ordinal: Column, text: Column) -> list[Column]:
    return [
        F.lit(section).alias("section"),
        ordinal.cast("int").alias("ordinal"),
        text.cast("string").alias("text"),
    ]


def schema_lines(df: DataFrame) -> DataFrame:
    """One Markdown table row per column: name, type, share of present cells."""
    names = df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(~missing(df, c)).alias(f"h{i}") for i, c in enumerate(names)],
    )
    long = wide.select(
        "n", wide_to_long([(F.col(f"h{i}"),) for i in range(len(names))], ["held"])
    )
    labels = F.array(*[F.lit(type_label(f.dataType)) for f in df.schema])
    return long.select(
        *_line(
            "schema",
            F.col("i"),
            F.format_string(
                "| %s | %s | %.1f%% |",
                name_of(names, F.col("i")),
                F.get(labels, F.col("i")),
                F.when(F.col("n") > 0, F.col("held") / F.col("n") * 100).otherwise(0.0),
            ),
        )
    )


def numeric_lines(df: DataFrame) -> DataFrame:
    fields = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    order = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column"))
    text = F.concat(
        F.lit("| "),
        F.concat_ws(" | ", F.col("column"), F.col("count").cast("string"), *values),
        F.lit(" |"),
    )
    return profile.describe_numeric(df).select(*_line("numeric", order, text))


def correlation_lines(df: DataFrame, top_n: int = 5) -> DataFrame:
    strongest = (
        correlate.correlation_pairs(df)
        .where(F.col("r").isNotNull())
        .orderBy(F.abs("r").desc(), "ia", "ib")
        .limit(top_n)
    )
    text = F.format_string(
        "| %s | %s | %.2f |", F.col("col_a"), F.col("col_b"), F.abs("r")
    )
    place = F.col("ia") * 10_000 + F.col("ib")
    return strongest.select(*_line("correlations", place, text))


def quality_lines(df: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(c) for c in health.CAPS]), F.col("category"))
    return (
        health.health_lines(df)
        .where(F.col("reason").isNotNull())
        .select(*_line("quality", order, F.concat(F.lit("- "), F.col("reason"))))
    )


def sample_lines(
    df: DataFrame, n_rows: int, plan: dict[str, list[str]], order_by: list[str] | None = None
) -> DataFrame:
    """Scrubbed sample rows: any, or the first in ``order_by`` order."""
    if n_rows <= 0:
        return df.sparkSession.createDataFrame([], "section string, ordinal int, text string")
    if order_by:
        rows = df.orderBy(*[quoted(c) for c in order_by]).limit(n_rows)
    else:
        rows = df.limit(n_rows)
    cells = [
        F.regexp_replace(
            F.replace(
                F.coalesce(masking.scrub_text(as_text(rows, c), plan.get(c, [])), F.lit("")),
                F.lit("|"),
                F.lit("\\|"),
            ),
            "\n",
            " ",
        )
        for c in df.columns
    ]
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return rows.select(*_line("sample", F.monotonically_increasing_id(), text))


def card_sections(
    df: DataFrame, n_rows: int = 3, plan: dict[str, list[str]] | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """All sections in long form (section, ordinal, text)."""
    plan = pii.pii_plan(df) if plan is None else plan
    parts = [schema_lines(df)]
    if numeric_columns(df):
        parts.append(numeric_lines(df))
    if len(numeric_columns(df)) > 1:
        parts.append(correlation_lines(df))
    parts.append(quality_lines(df))
    parts.append(sample_lines(df, n_rows, plan, order_by))
    return reduce(DataFrame.unionByName, parts)


def _table(head: list[str], lines: list[str]) -> str:
    bar = "| " + " | ".join(head) + " |"
    return "\n".join([bar, "|" + " --- |" * len(head), *lines])


def dataset_card(
    df: DataFrame,
    name: str = "table",
    n_rows: int = 3,
    max_tokens: int = MAX_TOKENS,
    order_by: list[str] | None = None,
) -> str:
    """Markdown card within a token budget (about four characters per token).

    Over budget the schema shrinks to the twenty columns with most missing cells, then
    the numeric summary goes.  Quality reasons always stay.
    """
    rows = df.count() if df.columns else 0
    if rows == 0:
        return "(empty table)"
    found: dict[str, list[str]] = {}
    for r in sorted(
        card_sections(df, n_rows, order_by=order_by).collect(), key=lambda r: r["ordinal"]
    ):
        found.setdefault(r["section"], []).append(r["text"])

    def build(schema: list[str], note: str, numeric: str) -> str:
        parts = [
            f"## {name}",
            f"### Schema ({len(df.columns)} columns, {rows} rows)",
            _table(["column", "type", "present"], schema),
        ]
        if note:
            parts.append(note)
        if numeric:
            parts += ["### Numbers", numeric]
        if "correlations" in found:
            head = ["first", "second", "abs. r"]
            parts += ["### Strongest correlations", _table(head, found["correlations"])]
        if "quality" in found:
            parts += ["### Quality", "\n".join(found["quality"])]
        if "sample" in found:
            parts += ["### Sample, scrubbed", _table(list(df.columns), found["sample"])]
        return "\n\n".join(parts)

    numeric = ""
    if "numeric" in found:
        head = ["column", "count", "mean", "std", "min", "25%", "50%", "75%", "max"]
        numeric = _table(head, found["numeric"])
    card = build(found["schema"], "", numeric)
    if estimate_tokens(card) <= max_tokens:
        return card
    worst = [
        r["column"]
        for r in profile.rank_columns_by_missing(df, WORST_COLUMNS).orderBy("place").collect()
    ]
    at = {c: i for i, c in enumerate(df.columns)}
    schema = [found["schema"][at[c]] for c in worst]
    left_out = len(df.columns) - len(worst)
    note = f"*({left_out} more columns left out)*" if left_out else ""
    card = build(schema, note, numeric)
    if estimate_tokens(card) <= max_tokens or not numeric:
        return card
    return build(schema, note, "*(left out to stay within the budget)*")


def scrubbed_card(
    df: DataFrame, n_rows: int = 3, max_chars: int = SCRUBBED_CHARS,
    order_by: list[str] | None = None,
) -> str:
    """Shape, schema and scrubbed sample; sample rows go one by one when too long."""
    rows = df.count() if df.columns else 0
    if rows == 0:
        return ""
    schema = [r["text"] for r in schema_lines(df).orderBy("ordinal").collect()]
    plan = pii.pii_plan(df)
    sample = [
        r["text"] for r in sample_lines(df, n_rows, plan, order_by).orderBy("ordinal").collect()
    ]

    def build(n: int) -> str:
        parts = [
            f"**Shape:** {rows} rows, {len(df.columns)} columns",
            "### Schema\n" + _table(["column", "type", "present"], schema),
        ]
        if n:
            parts.append("### Sample, scrubbed\n" + _table(list(df.columns), sample[:n]))
        return "\n\n".join(parts)

    n = len(sample)
    while n and len(build(n)) > max_chars:
        n -= 1
    return build(n)
