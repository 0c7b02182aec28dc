"""The stored tables: parquet folders, one sub-folder per run, and a log of finished runs.

A run writes its own folders and is logged last. A run that is repeated overwrites its folders, so
a lost driver or a retried micro-batch changes nothing; folders of runs that are not logged are
not read.
"""

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetrail import schemas
from pricetrail.operators.ingest import add_missing_columns

LATEST = T.StructType(
    [schemas.PRICES[c] for c in ("product_id", "price", "original_price", "is_sale", "scraped_at")]
)
_LOG = T.StructType(
    [
        T.StructField("observations", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("run", T.LongType()),
    ]
)


class PriceStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.root}/runs")
        except AnalysisException:
            return self.spark.createDataFrame([], _LOG)

    def last_run(self) -> int | None:
        """Number of the last finished run."""
        return self._log().agg(F.max("run")).head()[0]

    def next_run(self) -> int:
        last = self.last_run()
        return 0 if last is None else last + 1

    def is_finished(self, source: str, batch: int) -> bool:
        done = (F.col("source") == source) & (F.col("batch") == batch)
        return not self._log().filter(done).isEmpty()

    def _of_run(self, name: str, run: int | None, schema: T.StructType) -> DataFrame:
        if run is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/run={run}")

    def products(self) -> DataFrame:
        return add_missing_columns(self._of_run("products", self.last_run(), schemas.PRODUCTS))

    def latest(self) -> DataFrame:
        """Newest price of every product, kept up to date by each run."""
        return self._of_run("latest", self.last_run(), LATEST)

    def prices(
        self, first_day: dt.date | None = None, last_day: dt.date | None = None
    ) -> DataFrame:
        """Price history; the days prune folders before any file is opened."""
        return self._history("prices", schemas.PRICES, first_day, last_day)

    def unit_changes(self) -> DataFrame:
        return self._history("unit_changes", schemas.UNIT_CHANGES)

    def _history(
        self,
        name: str,
        schema: T.StructType,
        first_day: dt.date | None = None,
        last_day: dt.date | None = None,
    ) -> DataFrame:
        last = self.last_run()
        if last is None:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField("run", T.LongType())]).add(
            "day", T.DateType()
        )
        rows = self.spark.read.schema(stored).parquet(f"{self.root}/{name}")
        rows = rows.filter(F.col("run") <= last)
        if first_day is not None:
            rows = rows.filter(F.col("day") >= F.lit(first_day))
        if last_day is not None:
            rows = rows.filter(F.col("day") <= F.lit(last_day))
        return rows.select(*schema.fieldNames())

    def write(self, name: str, run: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")

    def write_by_day(self, name: str, run: int, rows: DataFrame, time: str) -> None:
        """Write in folders per day. Rebalancing merges small days and splits a large one."""
        by_day = rows.withColumn("day", F.to_date(time)).hint("rebalance", "day")
        by_day.write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/{name}/run={run}")

    def finish(self, run: int, observations: int, source: str, batch: int) -> None:
        entry = self.spark.createDataFrame(
            [(observations, source, batch)], "observations long, source string, batch long"
        )
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/runs/run={run}")
