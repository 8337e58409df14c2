"""Continuous ingestion of landed notes by Structured Streaming.

Identifiers are made by rule, so a note that lands again makes rows that are there already;
each batch is cut down to new sources, and joins the corpus together with its number in one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import notes
from ..runtime import materialise
from ..store import Store

#: The tables that a note has rows in.
_TABLES = ("sources", "chunks", "embeddings", "jobs")

#: Where the engine of a stream keeps the identity of its query; it comes from the checkpoint, so a restart has the same one.
_QUERY_ID = "sql.streaming.queryId"


def take_batch(store: Store, part: DataFrame, stream: str, number: int, tenant: str = "local") -> bool:
    """Add the notes of one batch to the corpus; False if that batch is there already.

    All tables and the batch's number change in one commit: a batch that failed anywhere has left
    nothing that is seen, and one that is given again after its commit adds nothing.
    """
    done = store.table("batches").where((F.col("stream") == stream) & (F.col("batch") == number))
    if not done.isEmpty():
        return False
    # four tables are made of a batch: its notes are read once, not four times
    made = notes(part.persist(), tenant)
    try:
        known = store.table("sources").where(F.col("tenant_id") == tenant).select("source_id")
        new = materialise(made["sources"].select("source_id").join(known, "source_id", "left_anti"), "landed")
        rows = {name: made[name].join(new, "source_id", "left_semi") for name in _TABLES}
        for name in ("sources", "embeddings", "jobs"):
            rows[name] = rows[name].withColumn("created_at", F.current_timestamp())
        store.commit({**rows, "batches": store.spark.createDataFrame([(stream, number)], "stream string, batch long")})
    finally:
        part.unpersist()
    return True


def ingest_notes(spark: SparkSession, landing: str, target: str, checkpoint: str, tenant: str = "local") -> StreamingQuery:
    """Ingest JSON notes (title, text, collection_id) landing in a folder into the corpus at ``target``; ends when all are read.

    An engine over ``target`` lists the sources at once and finds them after ``sync_index``.
    One writer at a time: no other may commit to the corpus meanwhile.
    """
    rows = spark.readStream.schema("title string, text string, collection_id string").json(landing)
    store = Store(spark, target)

    def batch(part: DataFrame, number: int) -> None:
        # part's own session carries the query's identity
        take_batch(store, part, part.sparkSession.sparkContext.getLocalProperty(_QUERY_ID) or checkpoint, number, tenant)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_items(spark: SparkSession, landing: str, target: str, checkpoint: str) -> StreamingQuery:
    """Items (guid, status, position) landing as JSON: the first of each guid goes to ``target``, whatever lands again does not.

    The guids seen so far are the stream's state, kept under its checkpoint, so a restart resumes
    where it was.
    """
    rows = spark.readStream.schema("guid string, status string, position long").json(landing).where("guid IS NOT NULL")
    return (
        rows.dropDuplicates(["guid"])
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
