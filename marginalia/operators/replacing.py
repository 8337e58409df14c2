"""Importer-owned sources replaced in place: only the buckets that change are written, and a cut-off run has one outcome.

Sources and their chunks are two Parquet tables, partitioned by a bucket of the item's identity, so an item's rows
lie in one bucket of each.  A replacement validates everything first and then takes three steps, each a dynamic
overwrite of the buckets concerned but the first: the new chunks beside the old ones in files of their own, then the sources, then the old chunks out.
Readers join chunks with sources, so they see an item change with the second step alone.  A
run that ended anywhere is told by what the tables hold: ``outcome`` says so and ``resolve`` ends it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import BROADCAST_ROWS, checked_broadcast, materialise

#: Buckets of both tables.
BUCKETS = 64

_SOURCES = "source_id string, item string, {keys}, title string, version int, import_id string, bucket int"
_CHUNKS = "source_id string, item string, chunk_index int, text string, import_id string, bucket int"


class ImportRefused(ValueError):
    """An import that would change what it may not, or that is not whole; nothing was written."""


class ImportedSources:
    """Sources with an identity of several ``keys``; the first key names an item, all of them its importer."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _read(self, name: str) -> DataFrame:
        schema = _SOURCES.format(keys=", ".join(f"{k} string" for k in self.keys)) if name == "sources" else _CHUNKS
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], schema)

    def sources(self) -> DataFrame:
        return self._read("sources")

    def chunks(self, *columns: Column | str) -> DataFrame:
        """Chunks of the sources that are there; with ``columns``, these of them alone, worked out before texts could be shuffled."""
        rows = self._read("chunks")
        if columns:
            rows = rows.select("source_id", *columns)
        return rows.join(self.sources().select("source_id"), "source_id", "left_semi")

    def _item(self, row: str = "") -> Column:
        return F.col(f"{row}{self.keys[0]}").cast("string")

    def _same(self) -> Column:
        """Does a source (s) have the identity of an incoming item (i)?"""
        return reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}")) for k in self.keys])

    def plan(self, items: DataFrame, chunks: DataFrame, version: int) -> DataFrame:
        """(item, action, source_id) for items (keys, title) and their chunks (item, chunk_index, text): what an import would do.

        insert: no source has the identity; skip: one has it, of this version; replace: one has it, of another.
        conflict: several have it; foreign: a source of the first key has another identity; empty: no chunk
        has text; repeated: the item comes twice.
        """
        held = self.sources().alias("s")
        asked = items.withColumn("item", self._item()).alias("i")
        met = asked.join(held, F.col("s.item") == F.col("i.item"), "left")
        mine = F.coalesce(self._same(), F.lit(False))
        counts = met.groupBy(F.col("i.item").alias("item")).agg(
            F.count_if(mine).alias("own"), F.count_if(F.col("s.item").isNotNull() & ~mine).alias("foreign"),
            F.max(F.when(mine, F.col("s.version"))).alias("had"), F.max(F.when(mine, F.col("s.source_id"))).alias("source_id"),
        )
        times = asked.groupBy("item").agg(F.count("*").alias("times"))
        spoken = chunks.where(F.trim("text") != "").groupBy("item").agg(F.count("*").alias("spoken"))
        rows = counts.join(times, "item").join(spoken, "item", "left")
        action = (
            F.when(F.col("item").isNull() | (F.col("times") > 1), "repeated")
            .when(F.col("spoken").isNull(), "empty")
            .when(F.col("foreign") > 0, "foreign")
            .when(F.col("own") > 1, "conflict")
            .when(F.col("own") == 0, "insert")
            .when(F.col("had").eqNullSafe(F.lit(version)), "skip")
            .otherwise("replace")
        )
        return rows.select("item", action.alias("action"), "source_id")

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "item")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _overwrite(self, name: str, rows: DataFrame) -> None:
        """Write the buckets of ``rows`` and leave the others' files as they are; ``rows`` is a written table."""
        self._write(name, rows, "overwrite")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("item"), F.lit(self.buckets)).cast("int")

    def run(self, items: DataFrame, chunks: DataFrame, version: int, import_id: str) -> DataFrame:
        """Carry out the plan and return it.  Any conflict, foreign source, empty or repeated item refuses the whole import."""
        plan = materialise(self.plan(items, chunks, version), "import-plan")
        bad = {r.action: r.n for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect() if r.action not in ("insert", "skip", "replace")}
        if bad:
            raise ImportRefused(", ".join(f"{n} {a}" for a, n in sorted(bad.items())))
        todo = plan.where("action IN ('insert', 'replace')").select("item", F.col("source_id").alias("old"))
        todo = materialise(todo.withColumn("source_id", self._named(import_id)).withColumn("bucket", self._bucket()), "import-todo")
        touched = todo.select("bucket").distinct()
        fresh = self._of(chunks, todo).withColumns({"source_id": self._named(import_id), "bucket": self._bucket()})
        fresh = fresh.select("source_id", "item", F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.lit(import_id).alias("import_id"), "bucket")
        self._prepare(fresh, touched)
        head = items.withColumn("item", self._item()).join(todo.select("item", "source_id", "bucket"), "item")
        head = head.select("source_id", "item", *[F.col(k).cast("string").alias(k) for k in self.keys], "title", F.lit(version).alias("version"), F.lit(import_id).alias("import_id"), "bucket")
        self._switch(head, todo, touched)
        self._clean(touched)
        return plan.select("item", "action")

    def _named(self, import_id: str) -> Column:
        """New identifiers by rule: a run that is repeated makes the same ones."""
        return F.concat(F.lit("src_"), F.substring(F.sha2(F.concat_ws("|", "item", F.lit(import_id)), 256), 1, 32))

    def _of(self, chunks: DataFrame, todo: DataFrame) -> DataFrame:
        """The chunks of the items to do; their texts are shuffled for that only if there are many other items."""
        others = materialise(chunks.select("item").distinct().join(todo.select("item"), "item", "left_anti"), "import-others")
        n = others.count()
        if not n:
            return chunks.where("item IS NOT NULL")
        if n <= BROADCAST_ROWS:
            return chunks.where("item IS NOT NULL").join(F.broadcast(others), "item", "left_anti")
        return chunks.join(todo.select("item"), "item", "left_semi")

    def _prepare(self, fresh: DataFrame, touched: DataFrame) -> None:
        """The new chunks go into files beside the old ones; what a run that was cut off left of the same ones goes first."""
        held = self._read("chunks")
        left = materialise(held.join(touched, "bucket", "left_semi").select("source_id").distinct().join(fresh.select("source_id").distinct(), "source_id", "left_semi"), "import-left")
        self._without(left)
        self._write("chunks", fresh, "append")

    def _switch(self, head: DataFrame, todo: DataFrame, touched: DataFrame) -> None:
        held = self.sources().join(touched, "bucket", "left_semi").join(todo.select(F.col("old").alias("source_id")).unionByName(todo.select("source_id")), "source_id", "left_anti")
        self._overwrite("sources", materialise(held.unionByName(head), "import-sources"))

    def _clean(self, touched: DataFrame) -> None:
        """Chunks without a source go from the buckets touched."""
        held = self._read("chunks").join(touched, "bucket", "left_semi").where("source_id IS NOT NULL").select("source_id").distinct()
        self._without(materialise(held.join(self.sources().select("source_id"), "source_id", "left_anti"), "import-loose"))

    def _without(self, gone: DataFrame) -> None:
        """Take the chunks of the sources ``gone`` (source_id), a written table, out of the buckets that have any.

        A bucket's rows are read where they lie and written as its new files, which take the place of
        the old ones when all are there, so texts are neither shuffled nor written twice; of a
        bucket without other rows, an empty row remains to be overwritten.
        """
        if gone.isEmpty():
            return
        gone, chunks = checked_broadcast(gone), self._read("chunks")
        many = materialise(chunks.select("source_id", "bucket").join(gone.withColumn("gone", F.lit(True)), "source_id", "left").groupBy("bucket").agg(F.count("gone").alias("gone"), F.count("*").alias("n")), "import-buckets")
        # a row for each bucket
        hit = [r for r in many.where("gone > 0").collect()]
        kept = chunks.where(F.col("bucket").isin(*[r.bucket for r in hit])).join(gone, "source_id", "left_anti").select(*chunks.columns)
        bare = [(r.bucket,) for r in hit if r.gone == r.n]
        if bare:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "chunk_index" else F.lit(0).alias(f.name) for f in chunks.schema.fields if f.name != "bucket"]
            kept = kept.unionByName(self.spark.createDataFrame(bare, "bucket int").select(*empty, "bucket"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/chunks")

    def outcome(self, import_id: str) -> str:
        """What became of a run: succeeded (sources are there), prepared (only chunks are) or none; partly, if some chunks have no source."""
        ours = F.col("import_id") == import_id
        made, switched = self._read("chunks").where(ours).select("source_id").distinct(), self.sources().where(ours).select("source_id")
        without = not made.join(switched, "source_id", "left_anti").isEmpty()
        if switched.isEmpty():
            return "prepared" if without else "none"
        return "partly" if without else "succeeded"

    def resolve(self, import_id: str) -> str:
        """End a run that was cut off: chunks that no source names go, as do those that a replacement left; returns the outcome before."""
        told = self.outcome(import_id)
        loose = self._read("chunks").where("source_id IS NOT NULL").join(self.sources().select("source_id"), "source_id", "left_anti").select("bucket").distinct()
        touched = materialise(loose, "import-loose")
        if not touched.isEmpty():
            self._clean(touched)
        return told
