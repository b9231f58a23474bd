"""Search of query files as they arrive: a file stream whose batches go through the same plan as tables do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.plans.index import Index
from strandline.plans.search import SearchOptions, search


def search_stream(spark: SparkSession, index: Index, folder: str, out: str, checkpoint: str, options: SearchOptions = SearchOptions()):
    """Parquet files of (query, seq) that appear in folder; results are appended to out, each batch once."""

    def write(batch: DataFrame, number: int) -> None:
        search(index, batch, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema("query string, seq string").parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
