"""Mixing sources to target weights by entropy balancing.

Each source has a target in words.  Of all rates between 0 and ``most`` that meet it, the
ones closest in relative entropy to "take everything once" are ``min(most, exp(tilt *
z))``, with z the document's size over its source's mean size; the tilt minimises a convex
dual and is found by Newton steps.  Every step is one aggregation of the (source, size)
histogram, so it costs nothing more when a source holds a third of the rows.

Rates become whole copies class by class, a class being the documents of one source and
size: going from long to short, each class takes the number of copies that leaves the
smallest error to the next.  Within a class the documents of smallest hash get the odd
copy.  So a document's copies follow from its source, size and hash, and two small
tables; no document rows are ranked or sent back to the documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import (
    WORD,
    checkpointed,
    fresh,
    quoted,
    ranked,
    text_of,
    written,
)

#: Weights by the rank of the source, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words to take over all words there are; and the most copies of a document or a source.
SHARE = 1.5
MOST = 2
#: Documents of a class that are ordered by hash in one task.
PIECE = 256
_ROUNDS = 80


def _source_key(column: str) -> Column:
    """Sorts by code point with null last, and is never null itself."""
    return F.coalesce(F.concat(F.lit("v"), F.col(quoted(column)).cast("string")), F.lit("w"))


def _words(column: str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def _targets(histogram: DataFrame, weights, share: float, most: int) -> DataFrame:
    """(source, source_size, target): shares by weight, none above ``most`` times its size.

    With a level L each source gets min(most * size, weight * L).  Every round reads two
    sums over the sources and raises the level until no source passes its limit.
    """
    totals = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = ranked(totals, [F.col("source")], "rank")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("rank") % len(weights)).cast("int") + 1,
    )
    sources = written(
        sources.withColumns({"weight": weight, "limit": F.col("source_size") * most}).drop("rank"),
        "sources",
    )
    whole = sources.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    budget = share * float(whole["s"] or 0)
    level = budget / whole["w"] if whole["w"] else 0.0
    while level:
        full = F.col("weight") * level >= F.col("limit")
        now = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0)).alias("fixed"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if not now["open"]:
            break
        raised = (budget - float(now["fixed"])) / now["open"]
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return sources.select(
        "source",
        "source_size",
        F.least(F.col("limit").cast("double"), F.col("weight") * level).alias("target"),
    )


def _tilts(histogram: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Adds mean and tilt to the targets: Newton steps on the dual, kept inside a bracket."""
    means = histogram.groupBy("source").agg(
        F.try_divide(
            F.sum((F.col("n") * F.col("size")).cast("double") * F.col("size")),
            F.sum(F.col("n") * F.col("size")),
        ).alias("mean")
    )
    nothing, limit = F.lit(None).cast("double"), F.col("target") >= F.col("source_size") * most
    state = checkpointed(
        targets.join(means, "source").select(
            "source",
            "source_size",
            "target",
            F.coalesce("mean", F.lit(1.0)).alias("mean"),
            F.lit(0.0).alias("tilt"),
            nothing.alias("low"),
            nothing.alias("high"),
            (limit | (F.col("source_size") == 0)).alias("settled"),
        )
    )
    z, words = F.col("size") / F.col("mean"), F.col("n") * F.col("size")
    rate = _rate(most)
    for _ in range(_ROUNDS):
        sums = (
            histogram.join(state.where("NOT settled"), "source")
            .groupBy("source")
            .agg(
                F.sum(words * rate).alias("taken"),
                F.sum(F.when(rate < most, words * z * rate)).alias("slope"),
            )
        )
        error = F.col("taken") - F.col("target")
        near = F.abs(error) <= F.greatest(F.lit(0.25), F.col("target") * 1e-9)
        low = F.when(error < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.try_divide(error, F.col("slope"))
        between = F.when(
            F.col("low").isNotNull() & F.col("high").isNotNull(),
            (F.col("low") + F.col("high")) / 2,
        ).when(F.col("high").isNull(), F.abs(F.col("tilt")) * 2 + 1).otherwise(
            -F.abs(F.col("tilt")) * 2 - 1
        )
        inside = (
            step.isNotNull()
            & F.coalesce(step > F.col("low"), F.abs(step) <= 4 * F.abs(F.col("tilt")) + 4)
            & F.coalesce(step < F.col("high"), F.abs(step) <= 4 * F.abs(F.col("tilt")) + 4)
        )
        state = checkpointed(
            state.join(sums, "source", "left")
            .withColumns({"low": low, "high": high, "near": F.coalesce(near, F.lit(False))})
            .withColumn("step", F.when(inside, step).otherwise(between))
            .select(
                "source",
                "source_size",
                "target",
                "mean",
                F.when(F.col("settled") | F.col("near"), F.col("tilt"))
                .otherwise(F.col("step"))
                .alias("tilt"),
                "low",
                "high",
                (F.col("settled") | F.col("near")).alias("settled"),
            )
        )
        if state.where("NOT settled").isEmpty():
            break
    else:
        raise RuntimeError(f"the tilts did not settle in {_ROUNDS} rounds")
    return state.drop("low", "high", "settled")


def _rate(most: int) -> Column:
    """Copies to expect of a document, from its size and its source's tilt."""
    power = F.col("tilt") * F.col("size") / F.col("mean")
    return F.when(
        F.col("target") >= F.col("source_size") * most, F.lit(float(most))
    ).otherwise(F.least(F.lit(float(most)), F.exp(F.least(power, F.lit(700.0)))))


def _copies(rates: DataFrame, most: int) -> DataFrame:
    """(source, size, n, rate, copies): whole copies of each class, errors handed on.

    One source's classes are bounded by its distinct sizes, not by its rows.
    """

    def round_off(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False, kind="stable")
        error, copies = 0.0, []
        for size, n, rate in zip(group["size"], group["n"], group["rate"]):
            wish = rate * n + (error / size if size else 0.0)
            taken = int(min(max(np.floor(wish + 0.5), 0), most * n))
            error = (wish - taken) * size if size else error
            copies.append(taken)
        return group.assign(copies=copies)

    return rates.groupBy("source").applyInPandas(
        round_off, "source string, size long, n long, rate double, copies long"
    )


def _thresholds(units: DataFrame, classes: DataFrame) -> DataFrame:
    """(source, size, last, some, m): the largest hash that still gets a class's odd copy, and
    how many of its ``m`` rows get one.

    A large class is cut by the leading bits of the hash; only the piece in which the odd
    copies run out is ordered.
    """
    odd = classes.where("odd > 0").withColumn(
        "bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / PIECE))).cast("int")
    )
    rows = units.join(odd.select("source", "size", "odd", "bits"), ["source", "size"]).withColumn(
        "piece", F.expr("CASE WHEN bits = 0 THEN 0L ELSE shiftrightunsigned(hash, 64 - bits) END")
    )
    keys = ["source", "size"]
    upto = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        rows.groupBy(*keys, "odd", "piece")
        .agg(F.sum("m").alias("m"))
        .withColumn("until", F.sum("m").over(upto))
        .where("until >= odd AND until - m < odd")
        .select(*keys, "piece", (F.col("odd") - F.col("until") + F.col("m")).alias("left"))
    )
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    within = (
        Window.partitionBy(*keys, "piece")
        .orderBy("unsigned")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.join(cut, [*keys, "piece"])
        .withColumn("unsigned", unsigned)
        .withColumn("until", F.sum("m").over(within))
        .where("until - m < left")
        .groupBy(*keys)
        .agg(F.max(F.struct("unsigned", (F.col("left") - F.col("until") + F.col("m")).alias("some"), "m")).alias("x"))
        .select(*keys, F.col("x.unsigned").alias("last"), F.least("x.some", "x.m").alias("some"), "x.m")
    )


def _with_copies(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds ``names["copies"]``: whole copies, and the odd one where the row's hash has it.

    ``names`` are the names of the columns hash, source, size, whole, last, some and m in
    ``rows``.  Where only some of the rows of the last hash get the odd copy, these rows, which
    share their id and text, are written with the number of their partition and counted by
    partition; no task numbers more rows than it has read.
    """
    c = {k: F.col(v) for k, v in names.items()}
    unsigned = c["hash"].bitwiseXOR(F.lit(-(1 << 63)))
    border = F.coalesce((unsigned == c["last"]) & (c["some"] < c["m"]), F.lit(False))
    odd = F.coalesce((unsigned <= c["last"]).cast("long"), F.lit(0))
    plain = rows.where(~border).withColumn(names["copies"], (c["whole"] + odd).cast("long"))
    piece, before, n = (fresh(plain, x) for x in ("piece", "before", "n"))
    keys = [names["source"], names["size"]]
    shared = written(rows.where(border).withColumn(piece, F.spark_partition_id()), "border")
    if shared.isEmpty():
        return plain
    upto = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        shared.groupBy(*keys, piece)
        .agg(F.count(F.lit(1)).alias(n))
        .withColumn(before, F.coalesce(F.sum(n).over(upto), F.lit(0)))
        .drop(n),
        "starts",
    )
    within = Window.partitionBy(*keys, piece).orderBy(piece)
    numbered = shared.withColumn(n, F.row_number().over(within)).join(starts, [*keys, piece])
    taken = (F.col(before) + F.col(n) <= c["some"]).cast("long")
    split = numbered.withColumn(names["copies"], (c["whole"] + taken).cast("long"))
    return plain.unionByName(split.select(*map(quoted, plain.columns)))


def mixing_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes).  ``rows``: (id, source, size, hash) of every row of ``docs``.

    ``classes``: (source, size, source_size, target, rate, whole, last, some, m): a document
    takes ``whole`` copies, and one more if its hash, read as unsigned, is less than ``last``;
    of the ``m`` rows whose hash is ``last``, as repeated rows have, ``some`` take one more.
    Null and empty texts have size 0 and are taken once; a null source is a source of its
    own; an empty table gives empty tables.
    """
    rows = written(
        docs.select(
            F.col(quoted(id_col)).alias("id"),
            _source_key(source_col).alias("source"),
            _words(text_col).alias("size"),
            _hash(id_col, text_col).alias("hash"),
        ),
        "sizes",
    )
    histogram = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    state = _tilts(histogram, _targets(histogram, weights, share, most), most)
    rates = histogram.join(state, "source").withColumn("rate", _rate(most))
    copies = written(_copies(rates.select("source", "size", "n", "rate"), most), "copies")
    classes = copies.withColumns(
        {"whole": F.floor(F.col("copies") / F.col("n")), "odd": F.col("copies") % F.col("n")}
    )
    units = rows.groupBy("source", "size", "hash").agg(F.count(F.lit(1)).alias("m"))
    last = _thresholds(units, classes)
    return rows, written(
        classes.join(last, ["source", "size"], "left")
        .join(state.select("source", "source_size", "target"), "source")
        .select("source", "size", "source_size", "target", "rate", "whole", "last", "some", "m"),
        "classes",
    )


def _hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit("mix"), F.col(quoted(id_col)).cast("string"), text_of(text_col))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, copies, rate."""
    rows, classes = mixing_plan(docs, **options)
    names = {x: x for x in ("hash", "source", "size", "whole", "last", "some", "m", "copies")}
    return _with_copies(rows.join(classes, ["source", "size"]), names).select(
        "id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "copies",
        "rate",
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **options,
) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the plan takes it, same columns."""
    _, classes = mixing_plan(docs, id_col, text_col, source_col, **options)
    own = {
        x: fresh(docs, x)
        for x in ("source", "size", "hash", "whole", "last", "some", "m", "copies", "copy")
    }
    named = classes.select(
        *[F.col(x).alias(own[x]) for x in ("source", "size", "whole", "last", "some", "m")]
    )
    tagged = docs.withColumns(
        {
            own["source"]: _source_key(source_col),
            own["size"]: _words(text_col),
            own["hash"]: _hash(id_col, text_col),
        }
    ).join(named, [own["source"], own["size"]])
    times = F.array_repeat(F.lit(1), F.col(own["copies"]).cast("int"))
    return (
        _with_copies(tagged, own)
        .withColumn(own["copy"], F.explode(times))
        .select(*map(quoted, docs.columns))
    )
