"""Importance resampling: documents drawn so that their words are like a target's.

Every feature (a run of words) falls into a bucket.  A bucket's gain is the logarithm of
its share in the target over its share in the documents, and a document's weight is the
sum of the gains of its features, looked up in one array.  Gumbel noise, fixed by the seed
and the document's id, turns the drawing by weight without replacement into taking the
highest scores.

The lowest score that is still drawn is found by selection, not by sorting all scores:
each block of rows gives the median of its remaining scores, and the median of these,
weighted by the blocks' remaining rows, has at least a quarter of all remaining rows on
either side.  Counting the rows above it tells which side goes, until the cutoff is met.
Only the rows from the cutoff on are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import (
    quoted,
    ranked,
    release_memory,
    small_batches,
    text_of,
    written,
)

#: Fixed values of the contract: smoothing of the counts, and steps of a logarithm's unit.
SMOOTH = 1
UNITS = 1000
#: Features whose buckets a worker remembers, and bytes of a text that are split at once.
REMEMBERED = 400_000
SLICE = 1 << 22
#: Rows of a block that gives one median, and scores that are few enough to look through.
BLOCK = 1 << 20
FEW = 4096

# Letters are lowered; whatever is no digit, letter or part of a longer character is a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, of letters A-Z in lower case, of other characters
    beyond ASCII."""
    return raw.translate(_FOLD).split()


def _runs(raw: bytes, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) of one slice of a text after the other, so that long texts stay small."""
    raw, start, last = raw.translate(_FOLD), 0, []
    while start < len(raw):
        end = len(raw)
        if end - start > SLICE:
            end = raw.find(b" ", start + SLICE)
            end = len(raw) if end < 0 else end
        words = raw[start:end].split()
        features = list(words)
        for n in range(2, longest + 1):
            joined = (last + words)[max(0, len(last) - n + 1) :]
            features += [b" ".join(joined[i : i + n]) for i in range(len(joined) - n + 1)]
        last = (last + words)[-(longest - 1) :] if longest > 1 else []
        yield len(words), features
        start = end


class _Buckets(dict):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = crc32(feature) % self.buckets
        return found

    def of(self, features: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, features), np.int32, len(features))


def _raw(batch: pa.RecordBatch, at: int) -> Iterator[bytes]:
    return (t.as_py() for t in batch.column(at))


def _counter(longest: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in _raw(batch, 0):
                for _, features in _runs(raw, longest):
                    np.add.at(totals, known.of(features), 1)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(totals[some])], ["bucket", "n"]
        )
        release_memory()

    return count


def bucket_counts(
    texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000
) -> np.ndarray:
    """Features of all texts by bucket; a task sends one row for each bucket it met."""
    small_batches(texts.sparkSession)
    rows = (
        texts.select(text_of(text_col).cast("binary").alias("text"))
        .mapInArrow(_counter(longest, buckets), "bucket int, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over source share, smoothed, rounded down."""
    s_all, t_all = float(source.sum()), float(target.sum())
    width = SMOOTH * len(source)
    return np.array(
        [
            math.floor(
                UNITS
                * math.log((float(t) + SMOOTH) * (s_all + width) / ((float(s) + SMOOTH) * (t_all + width)))
            )
            for s, t in zip(source, target)
        ],
        np.int64,
    )


def _scorer(gains, longest: int, buckets: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            words, features, weights = ([] for _ in range(3))
            for raw in _raw(batch, 1):
                n_words = n_features = weight = 0
                for n, found in _runs(raw, longest):
                    n_words, n_features = n_words + n, n_features + len(found)
                    weight += int(gains.value[known.of(found)].sum())
                words.append(n_words)
                features.append(n_features)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights))],
                ["id", "n_words", "n_features", "weight"],
            )
        release_memory()

    return score


def gumbel(seed: int, key: Column) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of the seed and the key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(float(-UNITS)) * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(median, rows) of every block of scores."""

    def one(block: list[np.ndarray]) -> pa.RecordBatch:
        scores = np.concatenate(block)
        middle = np.partition(scores, len(scores) // 2)[len(scores) // 2]
        return pa.RecordBatch.from_arrays([pa.array([middle]), pa.array([len(scores)])], ["m", "n"])

    block, held = [], 0
    for batch in batches:
        block.append(batch.column(0).to_numpy(zero_copy_only=False))
        held += len(block[-1])
        if held >= BLOCK:
            yield one(block)
            block, held = [], 0
    if held:
        yield one(block)


def cutoff(scores: DataFrame, take: int, few: int = FEW) -> int:
    """The ``take``-th highest of the one column of ``scores`` (a long, never null).

    ``take`` lies between 1 and the number of rows.  Every round has one row per block of a
    million rows on the driver.  When a quarter of a table is left, it is written anew, so
    that all rounds together read a few times the first table.
    """
    (name,) = scores.columns
    score = F.col(quoted(name))
    kept = scores
    size = left = scores.count()
    while left > few:
        middle, weight = np.array(
            [(r["m"], r["n"]) for r in kept.mapInArrow(_medians, "m long, n long").collect()]
        ).T
        order = np.argsort(middle)
        heap = np.cumsum(weight[order])
        pivot = int(middle[order][np.searchsorted(heap, heap[-1] / 2)])
        above, equal = kept.agg(F.count_if(score > pivot), F.count_if(score == pivot)).first()
        if above < take <= above + equal:
            return pivot
        if take <= above:
            kept, left = kept.where(score > pivot), above
        else:
            take -= above + equal
            kept, left = kept.where(score < pivot), left - above - equal
        if left <= size / 4 and left > few:
            kept, size = written(kept, "scores"), left
    return sorted((r[0] for r in kept.collect()), reverse=True)[take - 1]


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank.

    Of the rows with at least ``least_words`` words ``percent`` in a hundred are drawn
    (rounded down): those with the highest scores, of equal scores those with the smaller
    ids (null ids last; repeated rows in any order).  ``rank`` counts the drawn rows from 1
    and is null for the others.  Features are the runs of 1 to ``longest`` words.  A null or
    empty text has no features and weight 0; rows with the same id have the same noise; a
    target without words and an empty table are allowed, the latter gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    gains = spark.sparkContext.broadcast(
        bucket_gains(
            bucket_counts(docs, text_col, longest, buckets),
            bucket_counts(target, target_text, longest, buckets),
        )
    )
    own = docs.select(
        F.col(quoted(id_col)).alias("id"), text_of(text_col).cast("binary").alias("text")
    )
    id_type = own.schema["id"].dataType.simpleString()
    scored = written(
        own.mapInArrow(
            _scorer(gains, longest, buckets),
            f"id {id_type}, n_words long, n_features long, weight long",
        ).withColumn("score", F.col("weight") + gumbel(seed, F.col("id"))),
        "scored",
    )
    allowed = F.col("n_words") >= least_words
    take = percent * scored.where(allowed).count() // 100
    none = F.lit(None).cast("long")
    if take == 0:
        return scored.withColumn("rank", none)
    least = cutoff(scored.where(allowed).select("score"), take)
    winning = allowed & (F.col("score") >= least)
    place = ranked(
        scored.where(winning).withColumn("row", F.monotonically_increasing_id()),
        [F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features"), F.asc("row")],
        "rank",
    ).drop("row")
    drawn = place.withColumn("rank", F.when(F.col("rank") < take, F.col("rank") + 1).cast("long"))
    return drawn.unionByName(scored.where(~winning).withColumn("rank", none))


#: DuckDB SQL for the query; CRC-32 is spelled out over the bytes of the distinct words.
ORACLE = r"""
WITH steps AS (
  SELECT list(list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]),
         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT range AS i FROM range(0, 256))
),
docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
aims AS (
  SELECT regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
),
doc_words AS (SELECT doc_id, unnest(words) AS word FROM docs),
sides AS (
  SELECT word, count(*) AS s, 0 AS t FROM doc_words GROUP BY word
  UNION ALL
  SELECT word, 0, count(*) FROM (SELECT unnest(words) AS word FROM aims) GROUP BY word
),
vocabulary AS (SELECT word, hex(encode(word)) AS h, sum(s) AS s, sum(t) AS t FROM sides GROUP BY word),
hashed AS (
  SELECT word, s, v.t, xor(list_reduce(list_prepend(4294967295,
      list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, steps.t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary v, steps
),
counts AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((c.t + 1) * (a.s + 10000) / ((c.s + 1) * (a.t + 10000))))::BIGINT AS gain
  FROM counts c, totals a
),
weights AS (
  SELECT doc_id, count(*) AS n, sum(gain) AS w FROM doc_words JOIN hashed USING (word) JOIN gains USING (bucket)
  GROUP BY doc_id
),
scored AS (
  SELECT d.doc_id, len(d.words) AS n_features, coalesce(w.w, 0)::BIGINT AS weight,
    (coalesce(w.w, 0) + floor(-1000.0::DOUBLE * ln(-ln(
      (('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM docs d LEFT JOIN weights w USING (doc_id)
),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features::BIGINT AS n_features, s.weight, s.score,
  CASE WHEN p.r <= (SELECT 10 * count(*) // 100 FROM placed) THEN p.r END AS rank
FROM scored s LEFT JOIN placed p USING (doc_id)
"""
