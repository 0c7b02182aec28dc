"""Shared helpers: tables, work folders in shared storage, and Arrow batches."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Batches = Iterator[pa.RecordBatch]


#: Rows that are turned into Python texts together.
ROWS = 512


def by_rows(batches: Batches) -> Batches:
    """Batches in parts of at most ROWS rows, so that results leave a worker as they come."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: While a work table is written: its shuffle files go when it is there, and a Python worker is given
#: texts of this size at a time.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for a while; what the user has set comes back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class WorkFolder:
    """Intermediate tables in the shared folder the cluster names in spark.checkpoint.dir.

    A written table cuts the lineage: it is read again, not computed again, when executors are
    lost. `drop` removes one that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            checkpoints = spark.sparkContext.getCheckpointDir()
            if checkpoints is None and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            base = checkpoints or tempfile.mkdtemp(prefix="checkpoints-")
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        where = f"{self.path}/{name}"
        with settings(self.spark, WRITING):
            df.write.option("compression", codec).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)
