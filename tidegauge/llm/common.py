"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long: a batch of Spark's default number of rows would hold tens of megabytes on
    both sides of every Python worker.  A number that the user has set stays."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The files go to the folder that the cluster names in ``spark.checkpoint.dir``; only a
    session that has none (tests, notebooks) gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder of ``checkpoint``, read again.

    Unlike a checkpoint it forgets the filters and equalities that the optimizer has derived so far, which multiply
    in loops of self-joins, and it knows its size, so that small rounds join by broadcast.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-")
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def h64(data: bytes, seed: int = 0) -> int:
    """One 64-bit hash that is the same in every process."""
    return xxhash.xxh3_64_intdigest(data, seed)


_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def fields(spec: str) -> list[T.StructField]:
    """Fields of "name type, name type", without a session; array<...> of the simple types too."""
    out = []
    for part in spec.split(","):
        name, kind = part.split()
        inner = kind.removeprefix("array<").removesuffix(">")
        out.append(T.StructField(name, T.ArrayType(_TYPES[inner]) if inner != kind else _TYPES[kind]))
    return out
