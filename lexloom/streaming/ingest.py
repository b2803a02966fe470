"""Documents that arrive over time: upserts into the store, and counts of grams, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.functions import text as T
from lexloom.sources.tables import Store


def upsert_documents(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Keeps the newest of each document; a batch that is run again has the same result."""

    def each(batch: DataFrame, _: int) -> None:
        store.upsert("documents", batch.withColumn("text_length", F.length("full_text")))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gram_counts(stream: DataFrame, n: int = 4) -> DataFrame:
    """(gram, df): running document frequencies of character n-grams."""
    return stream.select(F.explode(F.array_distinct(T.char_grams(F.col("full_text"), n))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
