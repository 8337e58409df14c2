"""Re-embedding in key ranges that are planned once, done one by one and taken up again after a stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise
from .vector import compare_stored

#: Chunks of one range, about.
RANGE = 1_000_000

_PLAN = "batch int, low {kind}, high {kind}, chunks long"
_DONE = "action string, n long, batch int"


class Reembedding:
    """One run over ``chunks`` (doc_id and what ``fresh`` needs) against ``stored`` (doc_id, model, vector), kept under ``path``.

    ``fresh`` makes (doc_id, vector) of some chunks.  The first call plans ranges of about
    ``size`` chunks by doc_id.  A range writes its new vectors into its own folder, then its counts into ``done``;
    a range whose counts are there is done, and one that was cut off is written anew, so a run that is
    stopped and taken up again ends as one that was not.  ``source`` restricts the run to a source by
    the column source_id; vectors of other sources are left as they are.
    """

    def __init__(self, spark: SparkSession, path: str, chunks: DataFrame, stored: DataFrame, model: str, fresh: Callable[[DataFrame], DataFrame], size: int = RANGE, source: str | None = None) -> None:
        self.spark, self.path, self.model, self.fresh = spark, path.rstrip("/"), model, fresh
        self.chunks = chunks if source is None else chunks.where(F.col("source_id") == source)
        held = stored if source is None else stored.join(self.chunks.select("doc_id"), "doc_id", "left_semi")
        self.others = held.where(~F.col("model").eqNullSafe(F.lit(model)))
        self.own = held.where(F.col("model") == model).select("doc_id", "vector")
        self.size, self.kind = size, chunks.schema["doc_id"].dataType.simpleString()

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:  # not written yet
            return self.spark.createDataFrame([], schema)

    def plan(self) -> DataFrame:
        """(batch, low, high, chunks): the ranges, made once; both ends belong to a range."""
        schema = _PLAN.format(kind=self.kind)
        held = self._read("plan", schema)
        if not held.isEmpty():
            return held
        keys = self.chunks.select("doc_id").where("doc_id IS NOT NULL").unionByName(self.own.select("doc_id").where("doc_id IS NOT NULL"))
        keys = materialise(keys.distinct(), "reembed-keys")
        ranges = -(-keys.count() // self.size)
        if ranges:
            rows = keys.repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id().alias("batch"))
            rows = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("chunks"))
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/plan")
        return self._read("plan", schema)

    def done(self) -> DataFrame:
        """(action, n, batch) of the ranges that are done."""
        return self._read("done", _DONE)

    def left(self) -> DataFrame:
        """The ranges still to do, in order."""
        return self.plan().join(self.done().select("batch").distinct(), "batch", "left_anti").orderBy("low")

    def run(self, most: int | None = None) -> int:
        """Do the ranges that are left, or the first ``most`` of them; how many were done."""
        rows = self.left().limit(most) if most is not None else self.left()
        count = 0
        for r in rows.toLocalIterator():
            self._do(r.batch, F.col("doc_id").between(F.lit(r.low), F.lit(r.high)))
            count += 1
        return count

    def _do(self, batch: int, inside) -> None:
        fresh = materialise(self.fresh(self.chunks.where(inside)).select("doc_id", "vector"), "reembed-fresh")
        told = materialise(compare_stored(self.own.where(inside), fresh).select("doc_id", "action"), "reembed-told")
        changed = fresh.join(told.where("action IN ('created', 'updated')").select("doc_id", "action"), "doc_id")
        changed.write.mode("overwrite").parquet(f"{self.path}/vectors/batch={batch}")
        counts = told.groupBy("action").agg(F.count("*").alias("n"))
        # a range without rows is done as well
        counts = counts.unionByName(self.spark.createDataFrame([("none", 0)], "action string, n long"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/batch={batch}")

    def counts(self) -> DataFrame:
        """(action, n) of the ranges done: created, updated, unchanged, orphaned, and other_models among what is stored."""
        rows = self.done().where("n > 0").groupBy("action").agg(F.sum("n").alias("n"))
        others = self.others.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("other_models").alias("action"), "n")
        return rows.unionByName(others)

    def result(self, prune: bool = False) -> DataFrame:
        """(doc_id, model, vector) after the run: new vectors for old ones, and with ``prune`` none of other models."""
        new = self._read("vectors", f"doc_id {self.kind}, vector array<double>, action string, batch int").join(self.done().select("batch").distinct(), "batch", "left_semi")
        made = new.select("doc_id", F.lit(self.model).alias("model"), F.col("vector").cast("array<double>").alias("vector"))
        kept = self.own.join(new.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(self.model).alias("model"), F.col("vector").cast("array<double>").alias("vector"))
        rows = kept.unionByName(made)
        return rows if prune else rows.unionByName(self.others.select("doc_id", "model", F.col("vector").cast("array<double>").alias("vector")))
