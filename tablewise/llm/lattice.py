"""Language-model scoring by a subword lattice.

A word's lattice has the pieces of an existing vocabulary, with unigram scores that start
from the vocabulary's own and are fitted to the training words, and one arc over the whole
word with the word's share in the training texts.  The forward recursion adds up all paths
in log space.  Shares and scores are learned per class of documents (their language); a
text's probability is the sum over classes of the class's share times the product over its
words and its end, so the class of a text is never given, but summed out like the
segmentation.

    P_k(word) = (1 - b) ((1 - g) c_k/N_k + g c/N) + b (1 - e) lattice_k(word)
    P_k(end)  = (1 - b) ((1 - g) c_k/N_k + g c/N) + b e
    P(text)   = sum over k of share_k  prod over words P_k(word)  P_k(end)

with b = V / (N + V): the more new words the training texts brought, the more the pieces
count.  What is gathered is the table of words with their counts, one row per distinct
word.  Frequent words, a bounded number of them, are looked up beside the texts; the rest
go by a join, so every word counts whatever the size of that table.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import quoted, release_memory, small_batches, text_of, written
from tablewise.llm.pieces import Pieces, read_pieces
from tablewise.llm.subwords import Lattice

#: Classes that are told apart; documents of all others share one more.
CLASSES = 8
#: Words whose scores are broadcast at most (about 100 bytes each); the others are joined.
FREQUENT = 1 << 18
#: Share of the counts over all classes, and of the end among what was never seen.
OVER_ALL = 0.1
END = 0.01
#: Rounds in which the scores of the pieces are fitted to the training words.
ROUNDS = 3
WORDS_AT_ONCE = 50_000
#: Distinct words that a counting task holds before it passes its counts on.
HELD = 300_000
_TABLES: dict[str, tuple[dict[bytes, int], np.ndarray]] = {}


def held_out(id_col: str) -> Column:
    """Rows that are not learned from: crc32 of the id's text is 1 modulo 5."""
    text = F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 1


def _counter(classes: int):
    names = [f"c{k}" for k in range(classes)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, unseen = [Counter() for _ in names], set()

        def flush():
            words = list(set().union(*counts, unseen))
            columns = [pa.array(words, pa.binary())]
            columns += [pa.array([own.get(w, 0) for w in words], pa.int64()) for own in counts]
            return pa.RecordBatch.from_arrays(columns, ["word", *names])

        for batch in batches:
            for kind, text in zip(batch.column("kind").to_pylist(), batch.column("text")):
                words = text.as_py().lower().split()
                if kind < 0:
                    unseen.update(words)
                else:
                    counts[kind].update(words)
                if len(unseen) + sum(map(len, counts)) > HELD:
                    yield flush()
                    for own in (*counts, unseen):
                        own.clear()
        yield flush()
        counts.clear()
        unseen.clear()
        release_memory()

    return count


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to some ten thousand words."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= WORDS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _words_of(part: pa.Table) -> list[str]:
    return [w.decode("utf-8", "replace") for w in part.column("word").to_pylist()]


def _fit_pieces(words: DataFrame, pieces: Pieces, classes: int, rounds: int) -> list[np.ndarray]:
    """Scores of the pieces for each class, by expectation-maximisation over all words.

    A word counts once for each class whose training texts hold it.  A round sends one
    number per class and piece to the driver, as many as the vocabulary has at most.
    """
    context = words.sparkSession.sparkContext
    lattice = Lattice(pieces)
    shared = context.broadcast(lattice)
    scores = [lattice.prior] * classes
    for _ in range(rounds):
        given = context.broadcast(scores)

        def expect(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            uses = [np.zeros(shared.value.stop + 1) for _ in range(classes)]
            for part in _in_batches(batches):
                names = _words_of(part)
                for k in range(classes):
                    own = np.flatnonzero(part.column(f"c{k}").to_numpy() > 0)
                    if len(own):
                        uses[k] += shared.value.expected([names[i] for i in own], given.value[k])
            for k, own in enumerate(uses):
                used = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), k)), pa.array(used), pa.array(own[used])],
                    ["kind", "piece", "uses"],
                )

        found = (
            words.mapInArrow(expect, "kind long, piece long, uses double")
            .groupBy("kind", "piece")
            .agg(F.sum("uses").alias("uses"))
            .toPandas()
        )
        scores = []
        for k in range(classes):
            uses = np.zeros(lattice.stop + 1)
            own = found[found["kind"] == k]
            uses[own["piece"].to_numpy()] = own["uses"].to_numpy()
            scores.append(lattice.fitted(uses))
        given.unpersist()
    return scores


def _with_scores(lattice, scores):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_batches(batches):
            found = lattice.value.word_scores(_words_of(part), scores.value)
            sub = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1])
            yield from part.append_column(
                "sub", sub.cast(pa.list_(pa.float64()))
            ).combine_chunks().to_batches()

    return add


class Model:
    """Totals of the training texts: a few numbers per class."""

    def __init__(self, docs_of: list[int], words_of: list[int], distinct: int):
        self.ends = docs_of
        self.of = [d + w for d, w in zip(docs_of, words_of)]
        self.n = sum(self.of)
        self.v = distinct + (sum(docs_of) > 0)
        self.novel = self.v / (self.n + self.v) if self.n else 1.0
        self.shares = [(d + 1) / (sum(docs_of) + len(docs_of)) for d in docs_of]
        self.floor = self.n + 0.5 * (self.v + 1)

    def known(self, of_class, overall, k: int):
        """Share of what was seen, for counts as numbers, arrays or columns."""
        if not self.n:
            return overall * 0.0
        own = of_class / self.of[k] if self.of[k] else overall / self.n
        return (1 - self.novel) * ((1 - OVER_ALL) * own + OVER_ALL * overall / self.n)

    def end(self, k: int) -> float:
        return float(np.log10(self.known(self.ends[k], sum(self.ends), k) + self.novel * END))

    def base(self, count: float) -> float:
        return float(np.log10((count + 0.5) / self.floor)) if self.v else float(np.log10(1.0))

    @property
    def rest(self) -> float:
        return float(np.log10(self.novel * (1 - END)))

    def matrix(self, counts: np.ndarray, sub: np.ndarray) -> np.ndarray:
        """Columns: log10 P_k for each class, base log10, known (1 or 0)."""
        overall = counts.sum(axis=1)
        columns = []
        for k in range(counts.shape[1]):
            seen = self.known(counts[:, k], overall, k)
            with np.errstate(divide="ignore", under="ignore"):
                mixed = np.log10(seen + 10.0 ** (self.rest + sub[:, k]))
            columns.append(np.where(overall > 0, mixed, self.rest + sub[:, k]))
        columns += [np.log10((overall + 0.5) / self.floor), (overall > 0).astype(float)]
        return np.column_stack(columns)

    def columns(self, classes: int) -> list[Column]:
        """The same as expressions over a row of the word table."""
        overall = sum((F.col(f"c{k}") for k in range(classes)), F.lit(0))
        rests = [F.lit(self.rest) + F.col("sub")[k] for k in range(classes)]
        mixed = [
            F.when(
                overall > 0,
                F.log10(self.known(F.col(f"c{k}"), overall, k) + F.pow(F.lit(10.0), rest)),
            ).otherwise(rest)
            for k, rest in enumerate(rests)
        ]
        return [
            *mixed,
            F.log10((overall + 0.5) / self.floor),
            F.when(overall > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
        ]


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words over the least count that at most ``most`` words reach.

    Counts are put into logarithmic steps, of which there are a few hundred at most; no
    task sorts the words.
    """
    step = F.floor(F.log2("overall") * 16).cast("int")
    sizes = words.where("overall > 0").groupBy(step.alias("step")).count().collect()
    least, taken = None, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        taken += r["count"]
        if taken > most:
            break
        least = r["step"]
    if least is None:
        return words.limit(0)
    return words.where(F.col("overall") > 0).where(step >= least)


def _scorer(frequent, width: int):
    name = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One model at a time stays in a worker.
        if name not in _TABLES:
            _TABLES.clear()
            words, matrix = frequent.value
            _TABLES[name] = (dict(zip(words, range(len(words)))), matrix)
        at, matrix = _TABLES[name]
        for batch in batches:
            lengths, sums, starts, rare, times = [], [], [0], [], []
            for text in batch.column("text"):
                words = text.as_py().lower().split()
                place = np.fromiter(map(at.get, words, repeat(-1)), np.int64, len(words))
                missing = np.flatnonzero(place < 0)
                if len(missing):
                    others = Counter([words[i] for i in missing])
                    rare += others.keys()
                    times += others.values()
                    place = place[place >= 0]
                starts.append(len(rare))
                lengths.append(len(words) + 1)
                sums.append(matrix[place].sum(axis=0))
            pairs = pa.StructArray.from_arrays(
                [pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "times"]
            )
            flat = pa.array(np.concatenate(sums) if sums else np.zeros(0), pa.float64())
            edges = np.arange(0, width * (len(sums) + 1), width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("out"),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(edges), flat),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs),
                ],
                ["id", "out", "n_tokens", "sums", "rare"],
            )

    return score


def score_documents(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str = "lang",
    frequent_words: int = FREQUENT,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Words are lower-cased (A-Z) and split at ASCII white space; each text ends in one more
    token.  Null and empty texts consist of their end.  A null id counts as empty text, a
    null class belongs to the remaining classes; repeated rows count and are returned each
    time; an empty table gives an empty table.  If there is nothing to learn from, words
    have the scores of the vocabulary alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    label = F.coalesce(F.col(quoted(class_col)).cast("string"), F.lit(""))
    own = docs.select(
        F.col(quoted(id_col)).alias("id"),
        held_out(id_col).alias("out"),
        label.alias("label"),
        text_of(text_col).cast("binary").alias("text"),
    )
    found = (
        own.where("NOT out").groupBy("label").count().orderBy(F.desc("count"), "label")
        .limit(CLASSES).collect()
    )
    names = [r["label"] for r in found]
    classes = len(names) + 1
    kind = F.lit(classes - 1)
    for k, name in enumerate(names):
        kind = F.when(F.col("label") == name, F.lit(k)).otherwise(kind)
    kind = F.when(F.col("out"), F.lit(-1)).otherwise(kind)
    counts = [f"c{k}" for k in range(classes)]
    schema = "word binary, " + ", ".join(f"{c} long" for c in counts)
    counted = written(
        own.select(kind.alias("kind"), "text")
        .mapInArrow(_counter(classes), schema)
        .groupBy("word")
        .agg(*[F.sum(c).alias(c) for c in counts]),
        "counts",
    )
    pieces = read_pieces(path, lower=True)
    lattice = spark.sparkContext.broadcast(Lattice(pieces))
    scores = spark.sparkContext.broadcast(_fit_pieces(counted, pieces, classes, ROUNDS))
    words = written(
        counted.mapInArrow(_with_scores(lattice, scores), f"{schema}, sub array<double>"),
        "words",
    )
    overall = sum((F.col(c) for c in counts), F.lit(0))
    totals = words.agg(
        F.count_if(overall > 0).alias("distinct"), *[F.sum(c).alias(c) for c in counts]
    ).first()
    docs_of = dict(own.select(kind.alias("kind")).groupBy("kind").count().collect())
    model = Model(
        [docs_of.get(k, 0) for k in range(classes)],
        [totals[c] or 0 for c in counts],
        totals["distinct"],
    )
    top = _frequent(words.withColumn("overall", overall), frequent_words).drop("overall").toArrow()
    matrix = model.matrix(
        np.column_stack([top.column(c).to_numpy() for c in counts]).astype(float),
        np.array(top.column("sub").to_pylist(), float).reshape(-1, classes),
    )
    frequent = spark.sparkContext.broadcast((top.column("word").to_pylist(), matrix))
    width = classes + 2
    id_type = own.schema["id"].dataType.simpleString()
    partial = written(
        own.select("id", "out", "text")
        .mapInArrow(
            _scorer(frequent, width),
            f"id {id_type}, out boolean, n_tokens long, sums array<double>, "
            "rare array<struct<word: binary, times: long>>",
        )
        .withColumn("row", F.monotonically_increasing_id()),
        "partial",
    )
    sums = [f"s{i}" for i in range(width)]
    rare = (
        partial.select("row", F.explode("rare").alias("r"))
        .select("row", "r.word", "r.times")
        .join(words, "word")
        .select("row", *[(c * F.col("times")).alias(s) for c, s in zip(model.columns(classes), sums)])
        .groupBy("row")
        .agg(*[F.sum(s).alias(s) for s in sums])
    )
    total = [F.col("sums")[i] + F.coalesce(F.col(s), F.lit(0.0)) for i, s in enumerate(sums)]
    paths = [
        total[k] + float(np.log10(model.shares[k])) + model.end(k) for k in range(classes)
    ]
    ends = sum(model.ends)
    best = F.greatest(*[F.col(f"p{k}") for k in range(classes)]) if classes > 1 else F.col("p0")
    added = sum((F.pow(F.lit(10.0), F.col(f"p{k}") - F.col("best")) for k in range(classes)), F.lit(0.0))
    return (
        partial.join(rare, "row", "left")
        .select(
            "id",
            F.col("out").alias("held_out"),
            "n_tokens",
            (total[classes + 1] + float(ends > 0)).cast("long").alias("n_known"),
            F.lit(model.n).cast("long").alias("train_tokens"),
            (total[classes] + model.base(ends)).alias("base_score"),
            *[p.alias(f"p{k}") for k, p in enumerate(paths)],
        )
        .withColumn("best", best)
        .withColumn("score", F.col("best") + F.log10(added))
        .drop("best", *[f"p{k}" for k in range(classes)])
    )
