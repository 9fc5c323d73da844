"""Cleaning operators.  Each takes a DataFrame and returns an :class:`OpResult`.

``result.df`` is the cleaned plan; ``result.log``, a one-row frame that counts the changes
in a single pass, is planned when somebody asks for it.  Row-local operators run nothing.
Operators that need statistics or an order of the whole table (fills but by constants,
outliers, scaling, date layouts, narrowing, row numbers) read it at once for one small
row, which enters the plan as constants: a step adds one projection to the plan, and a
recipe's plan grows with the number of its steps.  Argument and schema errors are raised
at once; value errors surface when a job runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.columns import (
    FLOATING,
    as_double,
    as_text,
    dtype_of,
    is_numeric,
    is_text,
    melt,
    missing,
    name_of,
    number_text,
    present,
    quoted,
    replace_columns,
    require_columns,
    text_columns,
)
from tablewise.functions.dates import LAYOUTS, parse_pattern
from tablewise.functions.text import change_case, strip_edges
from tablewise.operators import stats
from tablewise.operators.footprint import narrowing_plan
from tablewise.operators.ordered import add_row_number, carry
from tablewise.operators.profile import IQR_MULTIPLIER, best_layout


class CleaningError(ValueError):
    """An operator got arguments it cannot work with."""


class OpResult:
    """The cleaned table and its one-row change log.

    ``changes`` holds the changed cells as (column, old, new), for operators that keep
    all rows and rewrite cells; it is None for the others.  Both are planned on demand.
    """

    def __init__(
        self,
        df: DataFrame,
        log: Callable[[], DataFrame],
        changes: Callable[[], DataFrame | None] = lambda: None,
    ):
        self.df, self._log, self._changes = df, log, changes

    @cached_property
    def log(self) -> DataFrame:
        return self._log()

    @cached_property
    def changes(self) -> DataFrame | None:
        return self._changes()


# ------------------------------------------------------------------ change log

EMPTY_WARNING = "the table is empty, nothing to do"


def _json(params: dict[str, Any]) -> str:
    return json.dumps(params, default=lambda v: sorted(v) if isinstance(v, set) else str(v))


def _log_row(
    rows: DataFrame,
    op: str,
    params: dict,
    before: Column,
    after: Column,
    cells: Column,
    affected: Column,
    warnings: Column,
) -> DataFrame:
    empty = F.when(before == 0, F.array(F.lit(EMPTY_WARNING))).otherwise(
        F.array().cast("array<string>")
    )
    return rows.select(
        F.lit(op).alias("op"),
        F.lit(_json(params)).alias("params"),
        before.cast("bigint").alias("rows_before"),
        after.cast("bigint").alias("rows_after"),
        cells.cast("bigint").alias("cells_changed"),
        affected.cast("array<string>").alias("affected_columns"),
        F.concat(empty, warnings.cast("array<string>")).alias("warnings"),
    )


def _texts(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def _rewrite(
    df: DataFrame,
    op: str,
    params: dict,
    exprs: dict[str, Column],
    warnings: Sequence[str] = (),
    changed: dict[str, Column] | None = None,
    late: Sequence[tuple[Column, str]] = (),
    always: bool = False,
) -> OpResult:
    """An operator that keeps all rows and replaces some columns.

    ``changed`` overrides the per-cell test for a change; ``late`` holds warnings that
    depend on the data; ``always`` lists every column as affected, changed or not.
    """
    changed = changed or {}
    names = list(exprs)
    tests = [
        changed.get(c, ~quoted(c).eqNullSafe(exprs[c])) if c in exprs else None
        for c in names
    ]
    def log() -> DataFrame:
        # The tests read old and new cells side by side, in one pass.
        flags = df.select(
            F.lit(1).alias("__row"),
            *[t.alias(f"t{i}") for i, t in enumerate(tests)],
            *[cond.alias(f"w{i}") for i, (cond, _) in enumerate(late)],
        )
        row = flags.agg(
            F.count("__row").alias("n"),
            *[F.count_if(F.col(f"t{i}")).alias(f"t{i}") for i in range(len(names))],
            *[F.coalesce(F.bool_or(f"w{i}"), F.lit(False)).alias(f"w{i}") for i in range(len(late))],
        )
        if always:
            affected = _texts(names)
        else:
            affected = F.array_compact(
                F.array(
                    F.lit(None).cast("string"),
                    *[F.when(F.col(f"t{i}") > 0, F.lit(c)) for i, c in enumerate(names)],
                )
            )
        cells = reduce(lambda a, b: a + b, [F.col(f"t{i}") for i in range(len(names))], F.lit(0))
        said = F.concat(
            _texts(warnings),
            F.array_compact(
                F.array(
                    F.lit(None).cast("string"),
                    *[F.when(F.col(f"w{i}"), F.lit(text)) for i, (_, text) in enumerate(late)],
                )
            ),
        )
        return _log_row(row, op, params, F.col("n"), F.col("n"), cells, affected, said)

    return OpResult(replace_columns(df, exprs), log, lambda: _changes(df, exprs, tests))


def _changes(df: DataFrame, exprs: dict[str, Column], tests: list[Column]) -> DataFrame | None:
    if not exprs or df.isStreaming:
        return None
    cells = [
        (
            test,
            number_text(quoted(c), dtype_of(df, c)),
            exprs[c].cast("string"),
        )
        for c, test in zip(exprs, tests)
    ]
    return (
        melt(df, cells, ["hit", "old", "new"], keep_nulls=True)
        .where("hit")
        .select(name_of(list(exprs), F.col("i").cast("int")).alias("column"), "old", "new")
    )


def _keep_rows(
    df: DataFrame,
    op: str,
    params: dict,
    keep: Column,
    affected: Sequence[str],
    warnings: Sequence[str] = (),
) -> OpResult:
    """An operator that drops the rows for which ``keep`` is not true.

    The predicate goes into the filter as it is, so that it can reach the scan.
    """
    def log() -> DataFrame:
        row = df.select(keep.alias("k")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("k")).alias("kept")
        )
        return _log_row(
            row, op, params, F.col("n"), F.col("kept"), F.lit(0), _texts(affected),
            _texts(warnings),
        )

    return OpResult(df.where(keep), log)


def _other(
    df: DataFrame, out: DataFrame, op: str, params: dict, affected: Sequence[str],
    warnings: Sequence[str] = (),
) -> OpResult:
    """Any other operator: rows are counted on both sides."""
    def log() -> DataFrame:
        sides = (
            df.select(F.lit(0).alias("side"))
            .unionAll(out.select(F.lit(1).alias("side")))
            .agg(
                F.count_if(F.col("side") == 0).alias("n"),
                F.count_if(F.col("side") == 1).alias("m"),
            )
        )
        return _log_row(
            sides, op, params, F.col("n"), F.col("m"), F.lit(0), _texts(affected),
            _texts(warnings),
        )

    return OpResult(out, log)


def _of_kind(
    df: DataFrame, columns: Sequence[str], fits: Callable[[T.DataType], bool], kind: str
) -> tuple[list[str], list[str]]:
    """Split the requested columns into usable ones and warnings about the others."""
    require_columns(df, columns)
    good = [c for c in columns if fits(dtype_of(df, c))]
    notes = [f"skipped {c!r}: not a {kind} column" for c in columns if c not in good]
    return good, notes


def _constants(rows: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> list[dict]:
    """Statistics per column as constants; null for a column without values.

    ``rows`` has at most one row (i, *fields) per column, so this reads as many.
    """
    kinds = {f: rows.schema[f].dataType for f in fields}
    found = {r["i"]: r for r in rows.select("i", *fields).collect()}
    return [
        {f: F.lit(found[i][f] if i in found else None).cast(kinds[f]) for f in fields}
        for i in range(len(columns))
    ]


def _no_stream(df: DataFrame, op: str) -> None:
    if df.isStreaming:
        raise CleaningError(
            f"{op} needs statistics or an order over the whole table; on a stream pass "
            "precomputed bounds to a row-local operator instead"
        )


# -------------------------------------------------------------- missing values

FILL_STRATEGIES = ("mean", "median", "mode", "constant", "ffill", "bfill")


def fill_missing(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    strategy: str = "median",
    value: Any = None,
    order_by: Sequence[str] | None = None,
    keys: Sequence[str] = (),
) -> OpResult:
    """Fill missing cells by mean, median, mode, a constant, or the nearest cell.

    ``ffill`` and ``bfill`` need ``order_by``, a total order of the rows; ``keys``
    keeps them inside groups.
    """
    params = {"columns": columns, "strategy": strategy, "value": value}
    if order_by:
        params |= {"order_by": list(order_by), "keys": list(keys)}
    if strategy not in FILL_STRATEGIES:
        raise CleaningError(f"unknown fill strategy {strategy!r}; use one of {FILL_STRATEGIES}")
    if strategy == "constant" and value is None:
        raise CleaningError("a constant fill needs a value")
    names = list(columns or df.columns)
    require_columns(df, names)
    if strategy != "constant":
        _no_stream(df, f"fill_missing({strategy})")
    fill = {
        "mean": _fill_by_mean,
        "median": _fill_by_median,
        "mode": _fill_by_mode,
        "constant": _fill_by_constant,
        "ffill": _fill_by_neighbour,
        "bfill": _fill_by_neighbour,
    }[strategy]
    if strategy in ("ffill", "bfill"):
        if not order_by:
            raise CleaningError(f"{strategy} needs order_by: a table has no row order")
        targets = [c for c in names if columns or c not in {*order_by, *keys}]
        return fill(df, params, targets, order_by, keys, strategy == "ffill")
    if strategy == "constant":
        return fill(df, params, names, value)
    return fill(df, params, names)


def _plug(df: DataFrame, name: str, value: Column) -> Column:
    return F.coalesce(present(df, name), value)


def _fill_by_mean(df: DataFrame, params: dict, names: list[str]) -> OpResult:
    good, notes = _of_kind(df, names, is_numeric, "numeric")
    if not good:
        return _rewrite(df, "fill_missing", params, {}, notes)
    means = _constants(
        stats.long_values(df, good).groupBy(F.col("i").cast("int").alias("i"))
        .agg(F.avg("v").alias("mean")), good, ["mean"]
    )
    exprs = {c: _plug(df, c, means[i]["mean"]) for i, c in enumerate(good)}
    return _rewrite(df, "fill_missing", params, exprs, notes)


def _fill_by_median(df: DataFrame, params: dict, names: list[str]) -> OpResult:
    good, notes = _of_kind(df, names, is_numeric, "numeric")
    if not good:
        return _rewrite(df, "fill_missing", params, {}, notes)
    middle = _constants(stats.quantiles(df, good, [0.5]), good, ["q0"])
    exprs = {c: _plug(df, c, middle[i]["q0"]) for i, c in enumerate(good)}
    return _rewrite(df, "fill_missing", params, exprs, notes)


def _fill_by_mode(df: DataFrame, params: dict, names: list[str]) -> OpResult:
    top = stats.most_frequent(df, names)
    exprs = {c: _plug(df, c, v) for c, v in zip(names, top) if v is not None}
    notes = [f"skipped {c!r}: no value present" for c, v in zip(names, top) if v is None]
    return _rewrite(df, "fill_missing", params, exprs, notes)


def _fill_by_constant(df: DataFrame, params: dict, names: list[str], value: Any) -> OpResult:
    exprs, notes = {}, []
    for c in names:
        fill = _constant_for(dtype_of(df, c), value)
        if fill is None:
            notes.append(f"skipped {c!r}: {value!r} does not fit its type")
        else:
            exprs[c] = _plug(df, c, fill)
    return _rewrite(df, "fill_missing", params, exprs, notes)


def _constant_for(dtype: T.DataType, value: Any) -> Column | None:
    """The constant as a column of the given type, None when it does not fit."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if is_text(dtype):
        return F.lit(str(value))
    if isinstance(dtype, T.BooleanType):
        return F.lit(value) if isinstance(value, bool) else None
    if is_numeric(dtype):
        if not number:
            return None
        if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
            return F.lit(value).cast(dtype)
        # A fraction widens an integer column to double, a large number to bigint.
        if not float(value).is_integer():
            return F.lit(float(value))
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(dtype), 63)
        fits = -(2**bits) <= value < 2**bits
        return F.lit(int(value)).cast(dtype if fits else "bigint")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(value).cast(dtype) if not number else None
    return None


def _fill_by_neighbour(
    df: DataFrame, params: dict, names: list[str], order_by, keys, forward: bool
) -> OpResult:
    filled = carry(df, names, order_by, keys, forward)
    exprs = {c: F.coalesce(present(df, c), F.col(f"__fill_{i}")) for i, c in enumerate(names)}
    wide = _rewrite(filled, "fill_missing", params, exprs)
    return OpResult(
        wide.df.select(*[quoted(c) for c in df.columns]),
        lambda: wide.log,
        lambda: wide.changes,
    )


def drop_missing(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    how: str = "any",
    thresh: int | None = None,
) -> OpResult:
    """Drop rows with missing cells; ``thresh`` present cells overrule ``how``."""
    params = {"columns": columns, "how": how, "thresh": thresh}
    if how not in ("any", "all"):
        raise CleaningError(f"how must be 'any' or 'all', got {how!r}")
    subset = list(columns or df.columns)
    require_columns(df, subset)
    need = thresh if thresh is not None else (len(subset) if how == "any" else 1)
    held = [~missing(df, c) for c in subset]
    if need <= 0:
        keep = F.lit(True)
    elif need == len(subset):
        keep = reduce(lambda a, b: a & b, held)
    elif need == 1:
        keep = reduce(lambda a, b: a | b, held)
    else:
        keep = reduce(lambda a, b: a + b, [h.cast("int") for h in held]) >= need
    return _keep_rows(df, "drop_missing", params, keep, subset)


# ------------------------------------------------------------------ duplicates

def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str = "first",
    order_by: Sequence[str] | None = None,
) -> OpResult:
    """Keep the first, the last, or none of the rows that agree on ``subset``.

    First and last go by ``order_by`` (default: the order of the whole row's values).
    Copies are folded by a grouped aggregate with map-side combining, so a key that
    covers a third of the table never gathers in one task.
    """
    params = {"subset": list(subset) if subset else None, "keep": keep}
    if order_by:
        params["order_by"] = list(order_by)
    if keep not in ("first", "last", "none"):
        raise CleaningError(f"keep must be 'first', 'last' or 'none', got {keep!r}")
    require_columns(df, [*(subset or []), *(order_by or [])])
    keys = list(subset or df.columns)
    # NaN and null are one missing value as keys, but the row that stays keeps its own.
    floating = [c for c in keys if isinstance(dtype_of(df, c), FLOATING)]
    rest = [c for c in df.columns if c not in keys or c in floating]
    group = [present(df, c).alias(f"g{i}") for i, c in enumerate(keys)]
    at_key = {c: F.col(f"g{i}").alias(c) for i, c in enumerate(keys) if c not in floating}

    if not rest and keep != "none":
        out = df.dropDuplicates()
    else:
        aggs = [F.count(F.lit(1)).alias("__n")]
        if rest:
            row = F.struct(*[quoted(c).alias(f"r{i}") for i, c in enumerate(rest)])
            rank = F.struct(
                *[quoted(c).alias(f"o{i}") for i, c in enumerate([*(order_by or []), *_sortable(df)])]
            )
            pick = F.max_by if keep == "last" else F.min_by
            aggs.append(pick(row, rank).alias("__row"))
        folded = df.groupBy(*group).agg(*aggs)
        if keep == "none":
            folded = folded.where("__n = 1")
        at = at_key | {c: F.col("__row")[f"r{i}"].alias(c) for i, c in enumerate(rest)}
        out = folded.select(*[at[c] for c in df.columns])
    return _other(df, out, "drop_duplicates", params, keys)


def _sortable(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]


# -------------------------------------------------------------------- outliers

def _fences(df: DataFrame, columns: list[str], multiplier: float) -> list[dict]:
    q = stats.quantiles(df, columns, [0.25, 0.75])
    spread = F.col("q1") - F.col("q0")
    q = q.withColumns(
        {
            "lower": F.col("q0") - multiplier * spread,
            "upper": F.col("q1") + multiplier * spread,
        }
    )
    return _constants(q, columns, ["lower", "upper"])


def _clipped(c: Column, lower: Column | None, upper: Column | None) -> Column:
    """Clip; missing cells and missing bounds leave the cell alone."""
    out = F.when(F.isnan(c), c)
    if lower is not None:
        out = out.when(c < lower, lower)
    if upper is not None:
        out = out.when(c > upper, upper)
    return out.otherwise(c)


def cap_outliers_iqr(
    df: DataFrame, columns: Sequence[str], multiplier: float = IQR_MULTIPLIER
) -> OpResult:
    """Clip values to the quartile fences; missing cells stay missing."""
    params = {"columns": list(columns), "multiplier": multiplier}
    good, notes = _of_kind(df, columns, is_numeric, "numeric")
    _no_stream(df, "cap_outliers_iqr")
    if not good:
        return _rewrite(df, "cap_outliers_iqr", params, {}, notes)
    fence = _fences(df, good, multiplier)
    exprs = {
        c: _clipped(
            quoted(c).cast("double"), fence[i]["lower"], fence[i]["upper"]
        )
        for i, c in enumerate(good)
    }
    return _rewrite(df, "cap_outliers_iqr", params, exprs, notes)


def remove_outliers_iqr(
    df: DataFrame, columns: Sequence[str], multiplier: float = IQR_MULTIPLIER
) -> OpResult:
    """Keep rows whose values lie within all fences (bounds included) or are missing."""
    params = {"columns": list(columns), "multiplier": multiplier}
    good, notes = _of_kind(df, columns, is_numeric, "numeric")
    _no_stream(df, "remove_outliers_iqr")
    keep = F.lit(True)
    if good:
        fence = _fences(df, good, multiplier)
        for i, c in enumerate(good):
            keep &= missing(df, c) | quoted(c).between(fence[i]["lower"], fence[i]["upper"])
    return _keep_rows(df, "remove_outliers_iqr", params, keep, good, notes)


# ------------------------------------------------------------------------ text

def strip_whitespace(df: DataFrame, columns: Sequence[str] | None = None) -> OpResult:
    """Strip white space of any script from both ends of text cells."""
    params = {"columns": list(columns) if columns else None}
    good, notes = _of_kind(df, list(columns or text_columns(df)), is_text, "text")
    exprs = {c: strip_edges(quoted(c)) for c in good}
    return _rewrite(df, "strip_whitespace", params, exprs, notes)


def standardize_case(df: DataFrame, columns: Sequence[str], case: str = "lower") -> OpResult:
    """Lower, upper or title case."""
    params = {"columns": list(columns), "case": case}
    if case not in ("lower", "upper", "title"):
        raise CleaningError(f"case must be 'lower', 'upper' or 'title', got {case!r}")
    good, notes = _of_kind(df, columns, is_text, "text")
    exprs = {c: change_case(quoted(c), case) for c in good}
    return _rewrite(df, "standardize_case", params, exprs, notes)


# ---------------------------------------------------------------------- schema

def rename_columns(df: DataFrame, mapping: dict[str, str]) -> OpResult:
    """Rename columns; line breaks, backticks and clashing names are refused."""
    if not isinstance(mapping, dict):
        raise CleaningError("mapping must be a dict of old to new names")
    require_columns(df, mapping)
    for old, new in mapping.items():
        if not isinstance(new, str):
            raise CleaningError(f"new name of {old!r} must be text, got {type(new).__name__}")
        if any(ch in new for ch in "\n\r`"):
            raise CleaningError(f"new name {new!r} holds a line break or a backtick")
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise CleaningError("renaming would give two columns the same name")
    out = df.select(*[quoted(c).alias(n) for c, n in zip(df.columns, names)])
    return _same_rows(df, out, "rename_columns", {"mapping": dict(mapping)}, list(mapping))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> OpResult:
    """Drop columns, all of which must exist."""
    require_columns(df, columns)
    out = df.select(*[quoted(c) for c in df.columns if c not in set(columns)])
    return _same_rows(df, out, "drop_columns", {"columns": list(columns)}, list(columns))


def _same_rows(df, out, op, params, affected, warnings=()) -> OpResult:
    def log() -> DataFrame:
        row = df.agg(F.count(F.lit(1)).alias("n"))
        return _log_row(
            row, op, params, F.col("n"), F.col("n"), F.lit(0), _texts(affected), _texts(warnings)
        )

    return OpResult(out, log)


# ----------------------------------------------------------------------- types

def parse_dates(
    df: DataFrame, columns: Sequence[str], format: str = "infer", errors: str = "coerce"
) -> OpResult:
    """Parse text into zone-free timestamps.

    ``infer`` takes the layout that explains most values of the column; otherwise a
    strftime (or Spark) pattern.  ``coerce`` turns failures into null, ``raise`` fails
    the job.  Timestamp columns are left alone.
    """
    params = {"columns": list(columns), "format": format, "errors": errors}
    if errors not in ("coerce", "raise"):
        raise CleaningError(f"errors must be 'coerce' or 'raise', got {errors!r}")
    require_columns(df, columns)
    exprs, changed, notes = {}, {}, []
    dated = (T.TimestampType, T.TimestampNTZType, T.DateType)
    texts = [c for c in columns if not isinstance(dtype_of(df, c), dated)]
    notes = [f"left {c!r} alone: already a date" for c in columns if c not in texts]
    if format == "infer" and texts:
        _no_stream(df, "parse_dates(infer)")
        best = df.agg(
            *[
                best_layout(F.array(*[F.count(x.parse(as_text(df, c))) for x in LAYOUTS]))
                .alias(f"b{i}")
                for i, c in enumerate(texts)
            ]
        ).first()
    for i, c in enumerate(texts):
        text = as_text(df, c)
        if format == "infer":
            layout = best[f"b{i}"]
            parsed = F.lit(None).cast("timestamp_ntz")
            if layout is not None and 0 <= layout < len(LAYOUTS):
                parsed = LAYOUTS[layout].parse(text)
        else:
            try:
                parsed = parse_pattern(text, format)
            except ValueError as exc:
                raise CleaningError(str(exc)) from exc
        if errors == "raise":
            parsed = F.when(
                text.isNotNull() & parsed.isNull(),
                F.raise_error(F.concat(F.lit(f"column {c}: not a date: "), text)),
            ).otherwise(parsed)
        exprs[c] = parsed
        changed[c] = text.isNotNull()
    return _rewrite(df, "parse_dates", params, exprs, notes, changed, always=True)


DTYPES = ("int", "float", "str", "category", "bool")


def cast_dtype(df: DataFrame, columns: Sequence[str], dtype: str) -> OpResult:
    """Cast to int, float, str, category (text stays text) or bool.

    Values that cannot be cast, and missing cells cast to int, fail the job.  Bool is
    true for non-zero numbers, non-empty texts and missing cells.
    """
    params = {"columns": list(columns), "dtype": dtype}
    if dtype not in DTYPES:
        raise CleaningError(f"unknown type {dtype!r}; use one of {DTYPES}")
    require_columns(df, columns)
    exprs = {c: _cast(df, c, dtype) for c in columns}
    out = replace_columns(df, exprs)
    return _same_rows(df, out, "cast_dtype", params, list(columns))


def _cast(df: DataFrame, name: str, dtype: str) -> Column:
    c, source = quoted(name), dtype_of(df, name)
    gone = missing(df, name)
    if dtype in ("str", "category"):
        return c if is_text(source) else as_text(df, name)
    if dtype == "bool":
        if isinstance(source, T.BooleanType):
            return F.coalesce(c, F.lit(True))
        if is_numeric(source):
            return F.when(gone, True).otherwise(c != 0)
        if is_text(source):
            return F.when(gone, True).otherwise(c != "")
        return F.lit(True)
    if dtype == "float":
        value = (F.trim(c) if is_text(source) else c).try_cast("double")
        bad = ~gone & value.isNull()
        note = F.concat(F.lit(f"column {name}: not a number: "), c.cast("string"))
        return F.when(bad, F.raise_error(note)).otherwise(value)
    # int: numbers are cut toward zero, texts must be whole numbers.
    if is_text(source):
        t = F.trim(c)
        value = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
    else:
        value = c.try_cast("bigint")
    note = F.concat(
        F.lit(f"column {name}: no whole number: "), F.coalesce(c.cast("string"), F.lit("missing"))
    )
    return F.when(gone | value.isNull(), F.raise_error(note)).otherwise(value)


def downcast_numeric(df: DataFrame) -> OpResult:
    """Narrow bigint to int and double to float where nothing is lost.

    The only operator that must look at the data before its schema is known: one
    small row of ranges and distinct counts.  Texts with few distinct values are
    listed as affected; their dictionary encoding is the file format's business.
    """
    _no_stream(df, "downcast_numeric")
    plan = narrowing_plan(df)
    exprs = {c: quoted(c).cast(t) for c, t in plan.items() if t != "category"}
    affected = [c for c in df.columns if c in plan]
    return _same_rows(df, replace_columns(df, exprs), "downcast_numeric", {}, affected)


# --------------------------------------------------------------------- numbers

def clip_range(
    df: DataFrame,
    columns: Sequence[str],
    lower: float | None = None,
    upper: float | None = None,
) -> OpResult:
    """Clip to an explicit range; missing cells stay missing."""
    params = {"columns": list(columns), "lower": lower, "upper": upper}
    if lower is None and upper is None:
        raise CleaningError("clip_range needs a lower or an upper bound")
    if lower is not None and upper is not None and lower > upper:
        raise CleaningError(f"lower bound {lower} is above upper bound {upper}")
    good, notes = _of_kind(df, columns, is_numeric, "numeric")
    exprs = {}
    for c in good:
        dtype = dtype_of(df, c)
        # Whole bounds keep an integer column's type, fractions widen it to double.
        whole = all(b is None or float(b).is_integer() for b in (lower, upper))
        target = dtype if whole or isinstance(dtype, (T.FloatType, T.DoubleType)) else T.DoubleType()
        lo = None if lower is None else F.lit(lower).cast(target)
        hi = None if upper is None else F.lit(upper).cast(target)
        cell = quoted(c).cast(target)
        exprs[c] = _clipped(cell, lo, hi) if isinstance(
            target, (T.FloatType, T.DoubleType)
        ) else _clipped_exact(cell, lo, hi)
    return _rewrite(df, "clip_range", params, exprs, notes)


def _clipped_exact(c: Column, lower: Column | None, upper: Column | None) -> Column:
    out = F.when(c.isNull(), c)
    if lower is not None:
        out = out.when(c < lower, lower)
    if upper is not None:
        out = out.when(c > upper, upper)
    return out.otherwise(c)


def _scale(df, op, params, columns, aggs, scaled, flat, flat_note, void_note) -> OpResult:
    """Shared frame of the two scalings: statistics as constants, then arithmetic."""
    good, notes = _of_kind(df, columns, is_numeric, "numeric")
    _no_stream(df, op)
    if not good:
        return _rewrite(df, op, params, {}, notes)
    seen = stats.long_values(df, good).groupBy(F.col("i").cast("int").alias("i")).agg(*aggs)
    fields = [c for c in seen.columns if c != "i"]
    found = _constants(seen, good, fields)
    exprs, late = {}, []
    for i, c in enumerate(good):
        known, x = found[i] | {"n": F.coalesce(found[i]["n"], F.lit(0))}, as_double(df, c)
        void = known["n"] == 0
        exprs[c] = F.when(flat(known), 0.0).when(void, x).otherwise(scaled(x, known))
        late.append((flat(known), f"{c!r} {flat_note}"))
        if void_note:
            late.append((void, f"{c!r} {void_note}"))
    return _rewrite(df, op, params, exprs, notes, late=late, always=True)


def normalize_minmax(df: DataFrame, columns: Sequence[str]) -> OpResult:
    """Map each column onto 0..1; a constant column becomes 0.0 on every row."""
    return _scale(
        df, "normalize_minmax", {"columns": list(columns)}, columns,
        (F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")),
        lambda x, s: (x - s["lo"]) / (s["hi"] - s["lo"]),
        lambda s: (s["n"] > 0) & (s["lo"] == s["hi"]),
        "is constant: set to 0.0", "skipped: no value present",
    )


def standardize_zscore(df: DataFrame, columns: Sequence[str]) -> OpResult:
    """Subtract the mean, divide by the population deviation; 0.0 without variation."""
    return _scale(
        df, "standardize_zscore", {"columns": list(columns)}, columns,
        (F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")),
        lambda x, s: (x - s["mean"]) / s["sd"],
        lambda s: (s["n"] == 0) | (s["sd"] == 0),
        "has no variation: set to 0.0", "",
    )


# ------------------------------------------------------------------------ rows

COMPARISONS = ("==", "!=", ">", ">=", "<", "<=", "in", "notin", "contains")


def row_predicate(df: DataFrame, column: str, op: str, value: Any) -> Column:
    """The filter as a Column; missing cells pass ``!=`` and ``notin`` only."""
    if op not in COMPARISONS:
        raise CleaningError(f"unknown comparison {op!r}; use one of {COMPARISONS}")
    require_columns(df, [column])
    c, gone = quoted(column), missing(df, column)
    dtype = dtype_of(df, column)
    if op in ("in", "notin"):
        if not isinstance(value, (list, tuple, set)):
            raise CleaningError(f"{op} needs a list of values, got {type(value).__name__}")
        alike = [v for v in value if v is not None and _comparable(dtype, v)]
        inside = ~gone & c.isin(alike) if alike else F.lit(False)
        return inside if op == "in" else ~F.coalesce(inside, F.lit(False))
    if op == "contains":
        if not isinstance(value, str):
            raise CleaningError(f"contains needs a text, got {type(value).__name__}")
        return as_text(df, column).contains(value)
    if not _comparable(dtype, value):
        if op in ("==", "!="):
            return F.lit(op == "!=")  # a number never equals a text
        raise CleaningError(f"cannot compare column {column!r} ({dtype}) with {value!r}")
    if op == "!=":
        return gone | (c != value)
    test = {
        "==": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value,
    }[op]
    # Spark orders NaN above all numbers, but a missing cell matches nothing.
    return ~gone & test


def _comparable(dtype: T.DataType, value: Any) -> bool:
    """Texts compare with texts and numbers with numbers; dates take both spellings."""
    if is_text(dtype):
        return isinstance(value, str)
    if is_numeric(dtype):
        return not isinstance(value, str)
    return True


def filter_rows(df: DataFrame, column: str, op: str, value: Any) -> OpResult:
    """Keep the rows whose cell compares as asked."""
    params = {"column": column, "op": op, "value": value}
    return _keep_rows(
        df, "filter_rows", params, row_predicate(df, column, op, value), [column]
    )


def reset_index(
    df: DataFrame, order_by: Sequence[str], drop: bool = True, name: str = "row_no"
) -> OpResult:
    """Number the rows 0..n-1 in ``order_by`` order, in column ``name``.

    An existing column of that name is replaced, or kept as ``index`` when ``drop`` is
    false; without one, ``drop=False`` writes the numbers to ``index`` as well.
    """
    params = {"order_by": list(order_by), "drop": drop, "name": name}
    if not order_by:
        raise CleaningError("reset_index needs order_by: a table has no row order")
    require_columns(df, order_by)
    _no_stream(df, "reset_index")
    old = name in df.columns
    if not drop and "index" in df.columns:
        raise CleaningError("the table already has a column named 'index'")
    body = [c for c in df.columns if c != name]
    fresh = "__number"
    numbered = add_row_number(df, order_by, fresh)
    columns = [quoted(c) for c in body]
    if not drop:
        columns.append((quoted(name) if old else F.col(fresh)).alias("index"))
    out = numbered.select(*columns, F.col(fresh).alias(name))
    return _same_rows(df, out, "reset_index", params, [])
