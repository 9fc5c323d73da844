"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, strips accents, turns look-alike letters of other scripts and digits
or signs that stand for letters into plain ones, and leaves words with one blank between.
The lexicon (whole words and word beginnings), its weights and the exception phrases are
learned from a bounded sample of labelled rows, in which each class stands for all of its
rows; the final score is a logistic function of the summed weight and of that weight over
the text's length.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import (
    fresh,
    quoted,
    release_memory,
    small_batches,
    text_of,
    written,
)

#: Labelled rows of each class that are learned from, all or about so many by hash of the id.
SAMPLE = 20_000
_PLACES = 1 << 40
#: Entries of the lexicon and of the learned exceptions at most.
ENTRIES = 4_000
#: Candidates that a counting task holds before it passes its counts on.
HELD = 200_000
#: Lengths of word beginnings that may become entries, and of whole words.
STEM = (4, 8)
LONGEST_WORD = 40
#: An entry must stand out by this many standard errors, and occur in so many toxic texts.
STANDS_OUT = 3.0
LEAST_ODDS = float(np.log(9))
SUPPORT = 4
#: Phrases in which an entry is harmless; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish")

# Letters of other scripts that look like Latin ones, and their likeness.
LOOKALIKES = dict(
    pair.split(":")
    for pair in (
        "а:a в:b с:c ԁ:d е:e ԍ:g һ:h і:i ј:j к:k м:m н:h о:o р:p ԛ:q ѕ:s т:t у:y ѡ:w х:x "
        "α:a β:b ε:e γ:y ι:i κ:k ν:v ο:o ρ:p τ:t υ:u χ:x "
        "ɑ:a ɡ:g ı:i ɩ:i ł:l ø:o đ:d ß:s"
    ).split()
)
# Digits and signs that stand for letters.
DIGITS = dict(zip("0134578", "oieastb"))
SIGNS = dict(zip("@$", "as"))

#: Columns of the unit counts: label, and half of the sample.
_COUNTS = ("clean0", "clean1", "toxic0", "toxic1")
_MARKS = regex.compile(r"\p{Mn}+")
_SIGN = regex.compile(r"(?<![@$])[@$](?=\p{L}|\d)")


class _Letters(dict):
    """Translation by code point, filled as characters are met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        c = LOOKALIKES.get(c, DIGITS.get(c, c))
        if not unicodedata.category(c).startswith("L"):
            c = " "
        elif c == "l":  # one class with i and 1
            c = "i"
        self[point] = c
        return c


_LETTERS = _Letters()


def fold(text: str) -> str:
    """The folded words of a text, each with a blank before and after; "" without words."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    words = text.translate(_LETTERS).split()
    return f" {' '.join(words)} " if words else ""


def _units(folded: str) -> set[str]:
    """Candidates for entries: whole words and beginnings of words."""
    found = set()
    low, high = STEM
    for word in set(folded.split()):
        if 3 <= len(word) <= LONGEST_WORD:
            found.add(f" {word} ")
        for n in range(low, min(high, len(word) - 1) + 1):
            found.add(f" {word[:n]}")
    return found


def _likeness(folded: str) -> int:
    """The least hash of the five-word shingles: near copies mostly share it."""
    words = folded.encode().split()
    if len(words) < 5:
        return xxhash.xxh64_intdigest(folded) >> 1
    shingles = map(b" ".join, zip(words, words[1:], words[2:], words[3:], words[4:]))
    return min(map(xxhash.xxh64_intdigest, shingles)) >> 1


@dataclass(frozen=True)
class Model:
    """What was learned; a few thousand entries at most, whatever the corpus."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    intercept: float = -3.0
    by_weight: float = 0.0
    by_density: float = 0.0
    _built: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_built": []}

    def automaton(self) -> ahocorasick.Automaton:
        if not self._built:
            machine = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                machine.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                machine.add_word(phrase, (len(phrase), 0.0))
            machine.make_automaton()
            self._built.append(machine)
        return self._built[0]

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries, those inside an exception left out."""
        if not folded or not (self.weights or self.exceptions):
            return []
        found, harmless = [], []
        for last, (length, weight) in self.automaton().iter(folded):
            span = (last + 1 - length, last + 1, weight)
            (found if weight else harmless).append(span)
        if harmless:
            found = [
                (a, b, w)
                for a, b, w in found
                if not any(x <= a and b <= y for x, y, _ in harmless)
            ]
        return found

    def features(self, folded: str) -> tuple[float, float]:
        """Summed weight, and weight per hundred words, both on a logarithmic scale."""
        hits = self.hits(folded)
        if not hits:
            return 0.0, 0.0
        total = sum(w for _, _, w in hits)
        words = folded.count(" ") - 1
        return float(np.log1p(total)), float(np.log1p(100 * total / words))

    def score(self, folded: str) -> float:
        weight, density = self.features(folded)
        z = self.intercept + self.by_weight * weight + self.by_density * density
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def held_out(id_col: str) -> Column:
    """Whether a row may not be learned from: crc32 of the id's text is 0 modulo 5."""
    number = F.crc32(F.col(quoted(id_col)).cast("string").cast("binary"))
    return F.coalesce(number % 5 == 0, F.lit(True))


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each unit, by label and by half of the sample."""
    counts = {name: Counter() for name in _COUNTS}

    def flush():
        units = list(set().union(*counts.values()))
        columns = [pa.array([own[u] for u in units], pa.int64()) for own in counts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), *columns], ["unit", *counts])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("folded", "toxic", "like"))
        for text, toxic, like in zip(*columns):
            counts[_COUNTS[2 * toxic + like % 2]].update(_units(text))
        if sum(map(len, counts.values())) > HELD:
            yield from flush()
            for own in counts.values():
                own.clear()
    yield from flush()
    counts.clear()
    release_memory()


def _lexicon(units: DataFrame, totals: dict[str, int], halves: tuple[int, ...]) -> dict[str, float]:
    """Entries that stand out in the given halves of the sample, with their log odds ratio."""
    clean, toxic = (sum(F.col(f"{c}{h}") for h in halves) for c in ("clean", "toxic"))
    clean_texts, toxic_texts = (sum(totals[f"{c}{h}"] for h in halves) for c in ("clean", "toxic"))
    odds = F.log((toxic + 0.5) / (toxic_texts + 1.0)) - F.log((clean + 0.5) / (clean_texts + 1.0))
    error = F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    best = (
        units.where(toxic >= SUPPORT)
        .withColumns({"odds": odds, "stands_out": odds / error})
        .where((F.col("stands_out") >= STANDS_OUT) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc("stands_out"), F.desc(F.length("unit")), "unit")
        .limit(ENTRIES)
        .collect()
    )
    kept: dict[str, float] = {}
    beginnings: set[str] = set()
    # Of a chain of beginnings the one that stands out most is enough, the longest of equals.
    for row in best:
        unit = row["unit"]
        stem = unit.rstrip()
        if unit in beginnings or any(stem[:n] in kept for n in range(STEM[0] + 1, len(stem) + 1)):
            continue
        kept[unit] = float(min(row["odds"], 8.0))
        beginnings.update(stem[:n] for n in range(STEM[0] + 1, len(stem) + 1))
    return kept


def _learned_exceptions(
    sample: DataFrame, lexicon: Model, stands_for: dict[int, float]
) -> frozenset[str]:
    """Two-word phrases around an entry that are common in clean texts and not in toxic ones."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, marks = [], []
            texts, toxics = batch.column("folded").to_pylist(), batch.column("toxic").to_pylist()
            for text, toxic in zip(texts, toxics):
                own = set()
                for start, end, _ in lexicon.hits(text):
                    begin = start + 1
                    stop = text.index(" ", begin)
                    before = text.rfind(" ", 0, start)
                    after = text.find(" ", stop + 1)
                    if start and before >= 0:
                        own.add(text[before : stop + 1])
                    if after >= 0:
                        own.add(text[start : after + 1])
                found += own
                marks += [toxic] * len(own)
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(found, pa.string()),
                                              "toxic": pa.array(marks, pa.int64())})

    rows = (
        sample.select("folded", "toxic")
        .mapInArrow(phrases, "phrase string, toxic long")
        .groupBy("phrase")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
        .where(
            (F.col("clean") >= 3)
            & (F.col("clean") * stands_for[0] >= 10 * F.col("toxic") * stands_for[1])
        )
        .orderBy(F.desc("clean"), "phrase")
        .limit(ENTRIES)
        .collect()
    )
    return frozenset(r["phrase"] for r in rows)


def _logistic(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x has a leading column of ones, and each
    line of it stands for so many ``rows``."""
    coefficients = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ coefficients, -30, 30)))
        gradient = x.T @ (rows * (y - p)) - ridge @ coefficients
        hessian = (x * (rows * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        coefficients = coefficients + step
        if np.abs(step).max() < 1e-8:
            break
    return coefficients


def _share(rows: int, wanted: int) -> int:
    """Places out of ``_PLACES`` that about ``wanted`` of ``rows`` rows fall on."""
    return _PLACES if rows <= wanted else _PLACES * wanted // rows


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """Learns from about ``sample_rows`` labelled rows of each class that are not held out.

    Ids that are labelled twice count as toxic if either label says so; null ids and null
    labels are left out.  A class that is drawn from counts as all of its labelled rows in
    the scale and in the exceptions, so scores keep to the true mix on tables of any size.
    Near copies in the sample count once.  Without labels of both kinds the lexicon is
    empty and every text gets the share of toxic labels as its score.
    """
    small_batches(docs.sparkSession)
    marked = (
        labels.select(
            F.col(quoted(id_col)).alias("id"),
            (F.col(quoted(label_col)).cast("int") == 1).alias("toxic"),
            held_out(id_col).alias("out"),
        )
        .where("id IS NOT NULL AND toxic IS NOT NULL AND NOT out")
        .groupBy("id")
        .agg(F.max("toxic").cast("long").alias("toxic"))
    )
    # A share of each class by hash of the id: what comes back is bounded, nothing is sorted.
    sizes = dict(marked.groupBy("toxic").count().collect())
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("id").cast("string")), F.lit(_PLACES))
    chosen = marked.where(
        F.when(F.col("toxic") == 1, place < _share(sizes.get(1, 0), sample_rows)).otherwise(
            place < _share(sizes.get(0, 0), sample_rows)
        )
    )
    drawn = dict(chosen.groupBy("toxic").count().collect())
    stands_for = {c: sizes[c] / drawn[c] if c in drawn else 1.0 for c in (0, 1)}

    @F.arrow_udf("string")
    def folded(texts: pa.Array) -> pa.Array:
        return pa.array([fold(t.as_py()) for t in texts], pa.string())

    @F.arrow_udf("long")
    def likeness(texts: pa.Array) -> pa.Array:
        return pa.array([_likeness(t.as_py()) for t in texts], pa.int64())

    sample = written(
        docs.select(F.col(quoted(id_col)).alias("id"), text_of(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")
        .select("id", "toxic", folded("text").alias("folded"))
        .withColumn("like", likeness("folded")),
        "sample",
    )
    one_of_each = sample.groupBy("like", "toxic").agg(F.min("id").alias("id"))
    sample = written(
        sample.join(F.broadcast(one_of_each), ["like", "toxic", "id"]).dropDuplicates(["like", "toxic"]),
        "distinct",
    )
    seen = sample.groupBy("toxic", (F.col("like") % 2).alias("half")).count().collect()
    totals = dict.fromkeys(_COUNTS, 0) | {_COUNTS[2 * r["toxic"] + r["half"]]: r["count"] for r in seen}
    clean, toxic = (totals[f"{c}0"] + totals[f"{c}1"] for c in ("clean", "toxic"))
    given = frozenset(f for f in map(fold, exceptions) if f)
    if not clean or not toxic:
        odds = (toxic * stands_for[1] + 0.5) / (clean * stands_for[0] + 1.5)
        return Model({}, given, min(float(np.log(odds)), -0.1))
    units = written(
        sample.select("folded", "toxic", "like")
        .mapInArrow(_count_units, "unit string, " + ", ".join(f"{c} long" for c in _COUNTS))
        .groupBy("unit")
        .agg(*[F.sum(c).alias(c) for c in _COUNTS])
        .where(f"toxic0 + toxic1 >= {SUPPORT}"),
        "units",
    )
    weights = _lexicon(units, totals, (0, 1))
    learned = given | _learned_exceptions(sample, Model(weights, given), stands_for)
    # The scale is fitted on hits of entries that were learned from the other half.
    others = [Model(_lexicon(units, totals, (1 - half,)), learned) for half in (0, 1)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, likes = batch.column("folded").to_pylist(), batch.column("like").to_pylist()
            pairs = [others[like % 2].features(text) for text, like in zip(texts, likes)]
            yield pa.RecordBatch.from_pydict(
                {
                    "weight": pa.array([a for a, _ in pairs], pa.float64()),
                    "density": pa.array([b for _, b in pairs], pa.float64()),
                    "toxic": batch.column("toxic"),
                }
            )

    data = sample.select("folded", "like", "toxic").mapInArrow(
        features, "weight double, density double, toxic long"
    ).toPandas().to_numpy(float)
    data = data[np.lexsort(data.T)]
    x = np.column_stack([np.ones(len(data)), data[:, :2]])
    rows = np.where(data[:, 2] == 1, stands_for[1], stands_for[0])
    intercept, by_weight, by_density = _logistic(x, data[:, 2], rows)
    return Model(weights, learned, float(intercept), float(by_weight), float(by_density))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Probability that a text is toxic, by the text alone; null counts as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        own = shared.value
        return pa.array([own.score(fold(t.as_py())) for t in texts], pa.float64())

    return scores(text_of(text_col))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Texts without a match, empty ones included, all get the same low score; repeated rows
    get equal scores; an empty table gives an empty table.
    """
    model = fit(docs, labels, id_col, text_col)
    return docs.select(
        F.col(quoted(id_col)).alias("id"),
        held_out(id_col).alias("held_out"),
        score(docs, model, text_col).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5, with the same columns."""
    model, mark = fit(docs, labels, id_col, text_col), fresh(docs, "score")
    return (
        docs.withColumn(mark, score(docs, model, text_col))
        .where(F.col(mark) < 0.5)
        .select(*map(quoted, docs.columns))
    )
