"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaweave.session import shared_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest table, in rows, that an operator sends to every executor. Larger ones are shuffled.
BROADCAST_ROWS = 500_000
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that go to a Python worker at once. Spark holds a batch as Arrow vectors and as direct buffers that double
#: as they grow, beside the heap, and the worker holds it once more; ten thousand whole texts would be some 30 MB each time.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n: the folds that decide what a model may learn from."""
    return F.crc32(key.cast("string").cast("binary")) % n


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """These session settings for what is run inside."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table in the cluster's shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    # The table takes the place of the shuffle files behind it.
    with settings(spark, {CLEAN_UP: "true", BATCH: str(BATCH_BYTES)}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a stored table for broadcast if it is counted to be small, else leave the join to a shuffle. Its rows are counted,
    not measured: a large table of lists is none for this."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def bounded_sample(df: DataFrame, key: str, max_rows: int, seed: int) -> DataFrame:
    """About `max_rows` rows chosen by a hash of the key: the same ones in each run, whatever the partitions."""
    n = df.count()
    if n <= max_rows:
        return df
    share = int(max_rows / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < share)
