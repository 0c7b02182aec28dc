"""Ingest files of observations as they arrive.

The stream brings no operators of its own: each micro-batch is one ingest run on the stored
tables, which hold all state. Spark numbers the micro-batches of a checkpoint folder; the store keeps
which of them are finished, so that a repeated one is skipped and every observation counts once, also
beside batch runs and other streams. A micro-batch of rejects only is stored as such and does not
hold up the next.
"""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pricetrail.plans.runs import ingest_run
from pricetrail.schemas import OBSERVATIONS
from pricetrail.sources.store import PriceStore


def ingest_stream(
    store: PriceStore, source: str, checkpoint: str, file_format: str = "parquet",
    files_per_run: int = 1000,
) -> StreamingQuery:
    """Ingest all files below `source` that were not ingested before, oldest first, then stop."""
    observed = (
        store.spark.readStream.schema(OBSERVATIONS)
        .option("maxFilesPerTrigger", files_per_run)
        .format(file_format)
        .load(source)
    )

    def run(batch: DataFrame, number: int) -> None:
        ingest_run(
            PriceStore(batch.sparkSession, store.root), batch, number,
            source=f"stream {checkpoint}", may_be_empty=True,
        )

    return (
        observed.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
