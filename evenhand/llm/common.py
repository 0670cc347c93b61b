"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenhand.session import shared_dir

#: A key with more than this share of all rows counts as a heavy key; there can be at most its inverse many.
HEAVY_SHARE = 1 / 2000
#: Folders written so far, for release().
WRITTEN: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that all executors see; only a local session may go without one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = shared_dir(spark, f"llm_{name}_{uuid.uuid4().hex[:12]}")
    WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the tables that this process has written on the way; call it once results have been read."""
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a written table: what reads it later needs none of the steps before, even when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names, in any case: result columns take the place of input columns of the same name."""
    low = {n.lower() for n in names}
    return df.select([c for c in quoted(df) if c.strip("`").lower() not in low])


def quoted(df: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``most`` bytes of the column (one row at least): memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = max(1, batch.column(column).nbytes // batch.num_rows)
        step = max(1, most // size)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of about ``most`` bytes from here on: a task, its buffers in the JVM and its Python worker hold a few batches each."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def giving_back(fn: Callable) -> Callable:
    """fn, a function over a partition's batches; after the last one the worker gives freed memory back to the system, which it would hold through later stages."""

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return run


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str, column: str) -> DataFrame:
    """fn over bounded pieces of the rows, as Arrow batches."""
    return df.mapInArrow(lambda batches: map(fn, slices(batches, column)), schema)


def skew_safe_join(left: DataFrame, right: DataFrame, keys: str | list[str], count: str, spread: Column) -> DataFrame:
    """left ⟕ right on keys that are unique in right; ``count`` holds the number of left rows of a key.

    Keys with over ``HEAVY_SHARE`` of the counted rows (at most 1 / HEAVY_SHARE of them) go by broadcast; for the
    others a key is at most that share of the rows, so that no task of the shuffle is large. Rows settled by the broadcast
    are spread by ``spread``, which takes the place of their first key. right should be a written table, as it is read three times.
    """
    keys = [keys] if isinstance(keys, str) else keys
    total = right.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) > max(1.0, total * HEAVY_SHARE)
    cols = [c for c in right.columns if c not in keys]
    few = F.broadcast(right.where(heavy).select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__h_{c}") for c in cols]))
    rest = right.where(~heavy).select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__c_{c}") for c in cols])
    own = left.join(few, [F.col(k) == F.col(f"__h{i}") for i, k in enumerate(keys)], "left")
    settled = F.col("__h0").isNotNull()
    own = own.withColumns({"__settled": settled, "__k0": F.when(settled, spread).otherwise(F.col(keys[0]))})
    both = own.join(rest, [F.col("__k0") == F.col("__c0"), *[F.col(k) == F.col(f"__c{i}") for i, k in enumerate(keys) if i]], "left")
    return both.select(*left.columns, *[F.when(F.col("__settled"), F.col(f"__h_{c}")).otherwise(F.col(f"__c_{c}")).alias(c) for c in cols])
