"""Plant known quality issues in a table, repeatably, for tests and demos."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.columns import dtype_of, quoted, replace_columns, require_columns
from tablewise.functions.masking import synthetic_value

NUMBER_WORDS = ("one", "two", "three", "four", "five")
DATE_PATTERNS = ("yyyy-MM-dd", "dd/MM/yyyy", "MMMM dd, yyyy", "dd-MMM-yy")


def bucket(key: Sequence[str], label: str, seed: int, buckets: int) -> Column:
    """Repeatable bucket 0..buckets-1 of a row, by its key."""
    h = F.xxhash64(F.lit(seed), F.lit(label), *[quoted(k) for k in key])
    return F.pmod(h, F.lit(buckets))


def _hit(key: Sequence[str], label: str, seed: int, share: float) -> Column:
    return bucket(key, label, seed, 1_000_000) < int(round(share * 1_000_000))


def inject_issues(
    df: DataFrame, key: Sequence[str], spec: Sequence[dict[str, Any]], seed: int = 42
) -> DataFrame:
    """Apply issues in order; which rows are hit depends on the key and seed only.

    Every entry names an ``issue``; most take ``column`` and ``share`` (0..1):
    nulls; outliers (``factor`` or ``value``); variants (``variants``: spellings that
    replace ``only``, or any value); unit (``unit`` appended); number_words;
    mixed_dates; constant (``column``, ``value``); mixed (numbers among texts);
    personal (``column``, ``category``); duplicates (``share`` of rows repeated).
    """
    require_columns(df, key)
    for k, entry in enumerate(spec):
        issue = entry.get("issue")
        if issue not in _ISSUES:
            raise ValueError(f"unknown issue {issue!r}; known: {sorted(_ISSUES)}")
        label = f"{k}/{issue}"
        share = float(entry.get("share", 1.0))
        if not 0.0 <= share <= 1.0:
            raise ValueError(f"share must be within 0..1, got {share}")
        df = _ISSUES[issue](df, key, label, seed, share, entry)
    return df


def _swap(df: DataFrame, column: str, hit: Column, value: Column, widen: bool = False) -> DataFrame:
    require_columns(df, [column])
    old = quoted(column)
    if widen:
        old = old.cast("string")
    return replace_columns(df, {column: F.when(hit, value).otherwise(old)})


def _nulls(df, key, label, seed, share, entry):
    c = entry["column"]
    require_columns(df, [c])
    gap = F.lit(None).cast(dtype_of(df, c))
    return _swap(df, c, _hit(key, label, seed, share), gap)


def _outliers(df, key, label, seed, share, entry):
    c = entry["column"]
    require_columns(df, [c])
    dtype = dtype_of(df, c)
    far = F.lit(entry["value"]) if "value" in entry else quoted(c) * entry.get("factor", 1000)
    return _swap(df, c, _hit(key, label, seed, share), far.cast(dtype))


def _variants(df, key, label, seed, share, entry):
    c = entry["column"]
    words = F.array(*[F.lit(v) for v in entry["variants"]])
    pick = F.get(words, bucket(key, label + "/word", seed, len(entry["variants"])).cast("int"))
    hit = _hit(key, label, seed, share)
    if "only" in entry:
        hit &= quoted(c) == entry["only"]
    return _swap(df, c, hit, pick)


def _unit(df, key, label, seed, share, entry):
    c = entry["column"]
    text = F.concat(quoted(c).cast("string"), F.lit(entry.get("unit", " cm")))
    return _swap(df, c, _hit(key, label, seed, share), text, widen=True)


def _number_words(df, key, label, seed, share, entry):
    c = entry["column"]
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])
    at = bucket(key, label + "/word", seed, len(NUMBER_WORDS)).cast("int")
    return _swap(df, c, _hit(key, label, seed, share), F.get(words, at), widen=True)


def _mixed_dates(df, key, label, seed, share, entry):
    c = entry["column"]
    require_columns(df, [c])
    patterns = entry.get("patterns", DATE_PATTERNS)
    at = bucket(key, label + "/pattern", seed, len(patterns))
    text = F.date_format(quoted(c), patterns[0])
    hit = _hit(key, label, seed, share)
    for i, p in enumerate(patterns[1:], start=1):
        text = F.when(hit & (at == i), F.date_format(quoted(c), p)).otherwise(text)
    return replace_columns(df, {c: text})


def _constant(df, key, label, seed, share, entry):
    return df.withColumn(entry["column"], F.lit(entry.get("value", "fixed")))


def _mixed(df, key, label, seed, share, entry):
    c = entry["column"]
    number = bucket(key, label + "/number", seed, 1000).cast("string")
    return _swap(df, c, _hit(key, label, seed, share), number, widen=True)


def _personal(df, key, label, seed, share, entry):
    source = F.concat_ws("/", *[quoted(k).cast("string") for k in key])
    fake = synthetic_value(source, entry["category"], seed)
    return df.withColumn(
        entry["column"], F.when(_hit(key, label, seed, share), fake)
    )


def _duplicates(df, key, label, seed, share, entry):
    return df.unionByName(df.where(_hit(key, label, seed, share)))


_ISSUES = {
    "nulls": _nulls,
    "outliers": _outliers,
    "variants": _variants,
    "unit": _unit,
    "number_words": _number_words,
    "mixed_dates": _mixed_dates,
    "constant": _constant,
    "mixed": _mixed,
    "personal": _personal,
    "duplicates": _duplicates,
}
