"""Incremental ingest: new files since the last run become records, each exactly once.

A run takes whatever is new and ends. Progress is the stream's checkpoint, so a run that died
goes on where it stopped, and rerunning without new files does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extract, records as rec
from ..sources import mail

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def scrubbed_records(docs: DataFrame) -> DataFrame:
    text = extract.scrubbed_patterns(extract.greeting_masked(F.coalesce("text", F.lit(""))))
    return docs.select(rec.record_id(F.col("doc_id").cast("string")).alias("record_id"), "source", text.alias("text"), tx.word_count(text).alias("word_count"), extract.confidence(extract.text_flags(F.coalesce("text", F.lit("")))).alias("confidence"))


def ingest_documents(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 100) -> int:
    """Parquet documents that arrived in ``folder`` -> records in ``out``; rows written."""
    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    run = scrubbed_records(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(p["numInputRows"] for p in run.recentProgress)


def ingest_mail(spark: SparkSession, folder: str, out: str, checkpoint: str) -> int:
    """New eml files in ``folder`` -> messages in ``out``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.eml").load(folder)
    rows = files.select("path", "content").mapInPandas(mail._rows(lambda raw: [raw]), mail.MESSAGE)
    run = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(p["numInputRows"] for p in run.recentProgress)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by window and kind, for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
