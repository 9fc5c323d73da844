"""Helpers that the operators share: tables, the shared folder, row keys, numbering."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words and the white space of the contracts (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Bytes of texts that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch, so that a few very long
    texts among ten thousand rows do not fill a worker's memory."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def release_memory() -> None:
    """Gives memory that a finished task used back to the machine, where the platform can:
    workers wait for further tasks, of other operators too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A session on one machine that names none, as in tests, gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: evaluated once, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A small table of an iteration, cut from its lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_of(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{stem}{n}"
    return name


def row_key(df: DataFrame) -> Column:
    """128 bits of hash over the whole row: rows share a key when all their columns are equal.

    Null flags are hashed too, as Spark's hash skips nulls; types that it cannot hash
    (maps, variants) go in as JSON.
    """
    parts: list[Column] = []
    for field in df.schema.fields:
        c = F.col(quoted(field.name))
        plain = field.dataType.simpleString()
        if "map<" in plain or "variant" in plain:
            c = F.to_json(F.struct(c))
        parts += [F.isnull(c), c]
    return F.struct(
        F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b")
    )


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keeps, with the columns of ``docs``.

    ``decisions`` has a row (key, kept) for each row of ``docs``, ``key`` being its
    ``row_key``.  Only keys that lose rows are joined back.  Of identical rows as many
    stay as were kept, at most one.
    """
    losing = written(
        decisions.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay"))
        .where("stay < n")
        .select(F.col("key.a").alias("a"), F.col("key.b").alias("b"), "stay"),
        "losing",
    )
    a, b, stay = (fresh(docs, x) for x in ("key_a", "key_b", "stay"))
    key = row_key(docs)
    tagged = docs.withColumns({a: key["a"], b: key["b"]})
    named = losing.toDF(a, b, stay)
    kept = tagged.join(named, [a, b], "left_anti").select(*map(quoted, docs.columns))
    if losing.where("stay > 0").isEmpty():
        return kept
    repeated = (
        tagged.join(named.where(F.col(stay) > 0), [a, b], "left_semi")
        .groupBy(a, b)
        .agg(F.first(F.struct(*[F.col(quoted(c)) for c in docs.columns])).alias(stay))
        .select(f"{stay}.*")
    )
    return kept.unionByName(repeated)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the position 0, 1, 2, ... in a total order.

    The sorted table is written, so that positions follow from its partitions; one row
    per partition is numbered in a single task, never the rows.
    """
    pid, mid = fresh(df, "pid"), fresh(df, "mid")
    ordered = written(
        df.orderBy(*order).withColumns(
            {pid: F.spark_partition_id(), mid: F.monotonically_increasing_id()}
        ),
        "ordered",
    )
    starts = (
        ordered.groupBy(pid)
        .agg(F.count(F.lit(1)).alias("n"), F.min(mid).alias("first"))
        .withColumn(
            "start",
            F.coalesce(
                F.sum("n").over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("n")
    )
    return (
        ordered.join(starts, pid)
        .withColumn(name, F.col("start") + F.col(mid) - F.col("first"))
        .drop(pid, mid, "start", "first")
    )
