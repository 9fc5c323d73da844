"""Labelled table versions with undo: one Parquet directory per state."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions.columns import digest_pair
from tablewise.sources.writers import write_parquet

MAX_VERSIONS = 10
_HEAD = -1
_SCHEMA = "place int, label string, path string, fingerprint string, stored_at timestamp"


def fingerprint(df: DataFrame) -> str:
    """Content hash that ignores row order: schema, row count and sums of row hashes."""
    h1, h2 = digest_pair(df, df.columns)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(h1.cast("decimal(38,0)")).alias("a"),
        F.sum(h2.cast("decimal(38,0)")).alias("b"),
    ).first()
    return f"{df.schema.simpleString()}|{row['n']}|{row['a']}|{row['b']}"


class TableVersions:
    """A stack of at most ``keep`` states below ``root``, newest last.

    Every change writes a new index beside the old ones and replaces nothing, so a crash
    leaves the last complete index in force.  States that fall off the stack, or were
    taken off it, keep their files, as tables may still read them: see :meth:`unused`.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = MAX_VERSIONS):
        if keep < 1:
            raise ValueError("a stack keeps at least one version")
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    @property
    def _index_path(self) -> str:
        return f"{self.root}/versions"

    def _rows(self) -> list[dict]:
        """All indexes, oldest first; each has a first row that marks it as complete."""
        try:
            rows = self.spark.read.schema(f"{_SCHEMA}, seq int").parquet(self._index_path).collect()
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted((r.asDict() for r in rows), key=lambda r: (r["seq"], r["place"]))

    def entries(self) -> list[dict]:
        return self._last(self._rows())[1]

    @staticmethod
    def _last(rows: list[dict]) -> tuple[int, list[dict]]:
        seq = max((r["seq"] for r in rows if r["place"] == _HEAD), default=-1)
        own = [r for r in rows if r["seq"] == seq and r["place"] != _HEAD]
        return seq, [{k: v for k, v in r.items() if k != "seq"} for r in own]

    def unused(self) -> list[str]:
        """Paths of stored states that the stack no longer holds."""
        rows = self._rows()
        held = {e["path"] for e in self._last(rows)[1]}
        return sorted({r["path"] for r in rows if r["path"] and r["path"] not in held})

    def table(self) -> DataFrame:
        """The index itself: one row per state."""
        return self.spark.createDataFrame(
            [tuple(e.values()) for e in self.entries()], _SCHEMA
        )

    def depth(self) -> int:
        return len(self.entries())

    def push(self, df: DataFrame, label: str) -> bool:
        """Store a state; False when it equals the newest one."""
        seq, entries = self._last(self._rows())
        mark = fingerprint(df)
        if entries and entries[-1]["fingerprint"] == mark:
            return False
        path = f"{self.root}/state-{uuid.uuid4().hex}"
        write_parquet(df, path)
        entries.append(
            {"place": 0, "label": label, "path": path, "fingerprint": mark,
             "stored_at": datetime.now(timezone.utc)}
        )
        self._save(seq + 1, entries[-self.keep:])
        return True

    def undo(self) -> DataFrame | None:
        """Take the newest state off the stack and return it; None when there is none."""
        seq, entries = self._last(self._rows())
        if not entries:
            return None
        last = entries.pop()
        self._save(seq + 1, entries)
        return self.spark.read.parquet(last["path"])

    def _save(self, seq: int, entries: list[dict]) -> None:
        rows = [(_HEAD, None, None, None, datetime.now(timezone.utc))] + [
            (i, e["label"], e["path"], e["fingerprint"], e["stored_at"])
            for i, e in enumerate(entries)
        ]
        self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(
            f"{self._index_path}/seq={seq}"
        )
