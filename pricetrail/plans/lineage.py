"""Materialize an intermediate result in reliable shared storage."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# As in `pricetrail.session`, for sessions made elsewhere: where the parsing of texts becomes one method above
# 8000 bytes, the JVM leaves it uncompiled.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


@contextmanager
def _small_methods(spark: SparkSession) -> Iterator[None]:
    """While a table is written; what the user has set comes back."""
    name, value = HUGE_METHOD
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the folder the cluster names and read again; survives the loss of executors.

    A written table is computed once, where a checkpoint computes its last stage twice.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            # Unset, as in tests on one machine; never on a cluster.
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    where = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    with _small_methods(df.sparkSession):
        df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
