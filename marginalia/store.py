"""A corpus as Parquet tables under one root, changed by whole commits.

A commit writes new folders and then one row that lists the folders of every table; the
newest such row is the state.  So a reader sees a commit whole or not at all, an append
never touches what is there, and a lost job leaves folders that nothing names.  One writer
at a time is assumed: of two that start from one state the later commit wins.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "version long, folders string, at long"

SCHEMAS = {
    "identities": "tenant_id string, user_id string, created_at timestamp",
    "sources": "source_id string, tenant_id string, collection_id string, source_type string, title string, language string, url string, show string, tree string, weight double, preference string, metadata string, created_at timestamp",
    "chunks": "chunk_id string, source_id string, tenant_id string, chunk_index int, text string, start_char int, end_char int, start_ms long, end_ms long, metadata string",
    "embeddings": "chunk_id string, source_id string, tenant_id string, model string, dimensions int, vector array<double>, created_at timestamp",
    "jobs": "job_id string, tenant_id string, source_id string, job_type string, status string, created_at timestamp",
    "entities": "tenant_id string, entity_type string, slug string, label string",
    "aliases": "tenant_id string, slug string, alias string",
    "source_entities": "source_id string, tenant_id string, slug string, role string",
    "items": "guid string, tenant_id string, kind string, status string, reason string, source_id string",
    "batches": "stream string, batch long",
}


class Store:
    """Named tables with fixed schemas; a table without rows is an empty DataFrame."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas or SCHEMAS

    def _state(self) -> tuple[int, dict[str, list[str]]]:
        log = f"{self.root}/log"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return 0, {}
        row = self.spark.read.schema(_LOG).parquet(log).orderBy(F.desc("version"), F.desc("at")).first()
        return (row.version, json.loads(row.folders)) if row else (0, {})

    def version(self) -> int:
        return self._state()[0]

    def table(self, name: str) -> DataFrame:
        folders = self._state()[1].get(name, [])
        schema = self.schemas[name]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, appended: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None) -> int:
        """Append rows to some tables and replace others as one step; returns the new version."""
        version, folders = self._state()
        for changes, keep in ((appended or {}, True), (replaced or {}, False)):
            for name, rows in changes.items():
                kinds = self.spark.createDataFrame([], self.schemas[name]).schema
                path = f"{self.root}/{name}/{uuid.uuid4().hex}"
                given = set(rows.columns)
                rows.select(*[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]).write.parquet(path)
                folders[name] = [*(folders.get(name, []) if keep else []), path]
        self.spark.createDataFrame([(version + 1, json.dumps(folders), time.time_ns())], _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return version + 1

    def compact(self, name: str, files: int = 1) -> int:
        """Rewrite a table of many appends into one folder of a few files."""
        return self.commit(replaced={name: self.table(name).repartition(files)})
