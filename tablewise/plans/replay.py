"""Replay a recorded list of cleaning steps on a full table.

A recipe is JSON: ``[{"op": "fill_missing", "params": {"strategy": "median"}}, ...]``.
Run it as a job with ``spark-submit -m tablewise.plans.replay`` or from Python.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewise.plans.registry import OPS, apply_op
from tablewise.sources.readers import load
from tablewise.sources.scratch import NoSharedFolderError, scratch_path
from tablewise.sources.writers import write_csv, write_parquet

log = logging.getLogger(__name__)
_FORBIDDEN = ("\n", "\r", "`")
#: Steps that read the whole table before they are planned.
STATISTIC = (
    "fill_missing", "cap_outliers_iqr", "remove_outliers_iqr", "normalize_minmax",
    "standardize_zscore", "parse_dates", "downcast_numeric", "reset_index_op",
)


def _walk(value: Any) -> Iterable[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(k)
            yield from _walk(v)
    elif isinstance(value, (list, tuple, set)):
        for v in value:
            yield from _walk(v)


def check_recipe(recipe: Iterable[Any]) -> list[tuple[str, dict]]:
    """Usable steps of a recipe; unknown steps are logged and left out.

    Texts with line breaks or backticks are refused, as they are in column names.
    """
    steps = []
    for entry in recipe:
        if isinstance(entry, (list, tuple)) and len(entry) == 2:
            op, params = entry
        elif isinstance(entry, dict):
            op, params = entry.get("op"), entry.get("params")
        else:
            op, params = None, None
        params = params or {}
        if op not in OPS or not isinstance(params, dict):
            log.warning("left out a step that is no known operator: %r", entry)
            continue
        for text in _walk(params):
            if any(ch in text for ch in _FORBIDDEN):
                raise ValueError(f"line break or backtick in a parameter of {op}: {text!r}")
        steps.append((op, params))
    return steps


def to_json(steps: Iterable[tuple[str, dict]]) -> str:
    return json.dumps(
        [{"op": op, "params": params} for op, params in steps], default=sorted
    )


def _written(df: DataFrame) -> DataFrame:
    """The table written once and read back; as it is where there is no place or type for that."""
    if df.isStreaming or any(isinstance(f.dataType, T.NullType) for f in df.schema):
        return df
    try:
        path = scratch_path(df.sparkSession, "replayed")
    except NoSharedFolderError:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replay(df: DataFrame, recipe: str | Iterable[Any]) -> DataFrame:
    """Apply the steps in order; an empty recipe returns the table as it is.

    Rows that are left after duplicates are dropped are written to the shared folder when
    later steps read statistics: each of those would group the whole table again.
    """
    entries = json.loads(recipe) if isinstance(recipe, str) else recipe
    steps = check_recipe(entries)
    for at, (op, params) in enumerate(steps):
        df = apply_op(df, op, **params).df
        if op == "drop_duplicates" and any(later in STATISTIC for later, _ in steps[at + 1:]):
            df = _written(df)
    return df


def main(argv: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(description="Replay cleaning steps on a table")
    cli.add_argument("recipe", help="JSON file with the steps")
    cli.add_argument("source")
    cli.add_argument("target")
    args = cli.parse_args(argv)
    spark = SparkSession.builder.appName("tablewise-replay").getOrCreate()
    recipe = "\n".join(r["value"] for r in spark.read.text(args.recipe).collect())
    out = replay(load(spark, args.source), recipe)
    writer = write_csv if args.target.rstrip("/").endswith(".csv") else write_parquet
    writer(out, args.target)


if __name__ == "__main__":
    main()
