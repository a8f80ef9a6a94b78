"""What the operators share: row keys, written tables, words, positive hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bindery.session import scratch_path

#: Texts that Python is sent at a time, in bytes, and Spark's setting for that.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Spark's setting by which a query's shuffle files go when it has ended, not when the driver collects its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, lost executors do not matter.

    Nothing reads the shuffles of this one write again, so their files go with its end. The
    session's own setting is put back.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_SETTING)
        else:
            spark.conf.set(CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python is sent at a time for the session, unless its user has set a bound.

    A batch is held several times over, by the executor and by its worker: by rows alone,
    10,000 of them, it grows with the texts.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def row_key() -> Column:
    """Names a document by its id and text, so that ids may repeat or be null.

    Rows alike in both are the same document and get the same result. Join it
    together with ``doc_id`` (null-safe).
    """
    return F.xxhash64(
        F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull()
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it; case does not tell columns apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column | str) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def same_key(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on ``names``."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out
