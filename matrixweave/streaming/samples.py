"""Statistics of samples as they arrive: each micro-batch holds whole new samples, whose results are added to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixweave.operators.stats import composition


def stream_compositions(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str):
    """Start a query that writes (sample_id, label, share) of each new file of ``source`` under ``out``; a batch that is repeated overwrites its own folder."""

    def add(batch: DataFrame, epoch: int) -> None:
        none = batch.select("sample_id", F.lit(None).cast("string").alias("grp")).distinct()
        composition(batch, none)[0].write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
