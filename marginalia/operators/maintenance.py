"""Upkeep of a corpus: deletes, overlays, merges, listings, generations, bundles."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def delete_sources(tables: dict[str, DataFrame], gone: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Every table without the rows of the deleted sources: no orphans can stay."""
    ids = gone.select(key).distinct()
    return {name: rows.join(ids, key, "left_anti") for name, rows in tables.items()}


def with_preferences(sources: DataFrame, preferences: DataFrame) -> DataFrame:
    """Weights and labels overlaid by (doc_id, weight, preference); a weight of 0 or less is an error."""
    given = preferences.select(
        "doc_id",
        F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.raise_error(F.lit("a weight is positive")).cast("double")).alias("new_weight"),
        F.col("preference").alias("new_preference"),
    )
    rows = sources.join(given, "doc_id", "left")
    rows = rows.withColumn("weight", F.coalesce("new_weight", "weight")).withColumn("preference", F.coalesce("new_preference", "preference"))
    return rows.drop("new_weight", "new_preference")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``, by an aggregate with partial sums, not a window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def missing(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(known.select(*keys), keys, "left_anti")


def two_hops(rows: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, title, target, outcome): key -> title -> target, with the reason where a hop fails."""
    named = rows.join(first.select("key", "title"), "key", "left")
    found = named.join(second.select("title", "target"), "title", "left")
    outcome = F.when(F.col("title").isNull(), "no_title").when(F.col("target").isNull(), "no_target").otherwise("ok")
    return found.select("key", "title", "target", outcome.alias("outcome"))


def upper_bound(value: Column, bounds: list[tuple[int, int]]) -> Column:
    """The number that belongs to the least upper bound not below the value; null beyond all.

    The bounds are a few literals, so the range join is an expression.
    """
    ordered = sorted(bounds)
    expr = F.when(value <= ordered[0][0], ordered[0][1])
    for bound, number in ordered[1:]:
        expr = expr.when(value <= bound, number)
    return expr


def keep_generations(rows: DataFrame, keep: int, group: str, generation: str) -> DataFrame:
    """Rows with ``kept``: true for the newest ``keep`` generations of each group."""
    return rows.withColumn("kept", F.expr(f"dense_rank() OVER (PARTITION BY {group} ORDER BY {generation} DESC)") <= keep)


def generation_key(name: Column) -> Column:
    """What a backup's name (``...-20240102T030405Z``, perhaps with fractions of a second) is ordered by; null for other names."""
    pattern = r"(\d{8}T\d{6})(?:\.(\d{1,9}))?Z(?:\.[a-z0-9.]+)?$"
    return F.when(name.rlike(pattern), F.concat(F.regexp_extract(name, pattern, 1), F.lit("."), F.rpad(F.regexp_extract(name, pattern, 2), 9, "0")))


def drift(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: chunks, indexed, missing from the index, stale in it."""
    both = chunks.select("doc_id", F.lit(1).alias("c")).join(indexed.select("doc_id", F.lit(1).alias("i")).distinct(), "doc_id", "full")
    return both.agg(
        F.count("c").alias("chunks"), F.count("i").alias("indexed"), F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("stale")
    )


def merge_plan(stored: DataFrame, incoming: DataFrame, key: str = "identity", version: str = "version") -> DataFrame:
    """(identity, action): insert, skip, replace, keep or conflict, by a full join on the identity.

    An identity stored more than once is a conflict; an older version is replaced.
    """
    old = stored.groupBy(key).agg(F.count("*").alias("times"), F.max(version).alias("old"))
    new = incoming.groupBy(key).agg(F.max(version).alias("new"))
    action = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("times") > 1, "conflict")
        .when(F.col("new").isNull(), "keep")
        .when(F.col("old") < F.col("new"), "replace")
        .otherwise("skip")
    )
    return old.join(new, key, "full").select(key, action.alias("action"))


def merged_metadata(left: Column, right: Column) -> Column:
    """Two JSON objects as one; the right one wins.  Values keep their types; what is no object counts as empty."""
    kind = "map<string,variant>"

    def members(text: Column) -> Column:
        return F.coalesce(F.from_json(F.when(text.rlike(r"^\s*\{"), text), kind), F.create_map().cast(kind))

    a, b = members(left), members(right)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


class BundleRefused(ValueError):
    """A bundle that is not what its manifest says, or beyond the limits."""


class BundleLimits(NamedTuple):
    """The most that a bundle may hold; a file's bytes are hashed as one row, which bounds them."""

    file_bytes: int = 1 << 30
    total_bytes: int = 1 << 50
    files: int = 10_000_000

    def check(self) -> None:
        if any(type(x) is not int or x <= 0 for x in self) or self.file_bytes >= 1 << 31:
            raise BundleRefused("limits are positive whole numbers, a file's below 2 GiB")


_LISTING = "name string, bytes long, sha256 string"


def _plain(name: str) -> bool:
    """Is it a table's name: letters, digits and ``_``, and none that a bundle has for itself?"""
    return re.fullmatch(r"[A-Za-z0-9]\w*", name, re.ASCII) is not None and name not in ("files", "manifest")


def _listed(spark: SparkSession, path: str, hashed: bool) -> DataFrame:
    """(name, bytes, sha256) of a bundle's data files, hashed where they lie, a file a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return files.where(~F.startswith(name, F.lit("files/"))).select(name.alias("name"), F.col("length").alias("bytes"), (F.sha2("content", 256) if hashed else F.lit(None).cast("string")).alias("sha256"))


def _within(files: DataFrame, limits: BundleLimits) -> dict:
    """Number, bytes and digest of a file listing, which may be long; over a limit it is refused."""
    limits.check()
    seal = F.bit_xor(F.xxhash64("name", "bytes", "sha256"))
    told = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("bytes").alias("most"), F.coalesce(seal, F.lit(0)).alias("seal")).first()
    if (told.most or 0) > limits.file_bytes or told.bytes > limits.total_bytes or told.files > limits.files:
        raise BundleRefused("files, bytes in all or bytes of a file are over the limits")
    return {"files": told.files, "bytes": told.bytes, "seal": told.seal}


def export_bundle(tables: dict[str, DataFrame], path: str, settings: dict | None = None, limits: BundleLimits = BundleLimits()) -> None:
    """Parquet for every table, a listing of the files with their SHA-256, and a manifest; never overwrites.

    The manifest (counts, schemas, ``settings``, a seal over the listing) is written last, by Spark, so an
    unfinished bundle has none.  Names of tables are letters, digits
    and ``_``.
    """
    limits.check()
    bad = [n for n in tables if not _plain(n)]
    if bad or not tables:
        raise BundleRefused(f"tables have plain names, not {bad}")
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for name, rows in sorted(tables.items()):
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
        entries.append({"table": name, "rows": spark.read.parquet(f"{path}/{name}").count(), "schema": json.loads(rows.schema.json())})
    _within(_listed(spark, path, False), limits)  # before any file is read as one row
    _listed(spark, path, True).write.mode("errorifexists").parquet(f"{path}/files")
    sealed = _within(spark.read.schema(_LISTING).parquet(f"{path}/files"), limits)
    manifest = json.dumps({"format": "marginalia-bundle", "format_version": 2, "settings": settings or {}, "tables": entries, **sealed})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> dict:
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])
    except json.JSONDecodeError as e:
        raise BundleRefused("the manifest cannot be read") from e
    if not isinstance(manifest, dict) or manifest.get("format") != "marginalia-bundle" or manifest.get("format_version") != 2:
        raise BundleRefused("not a bundle of this format")
    if not all(_plain(str(e.get("table"))) for e in manifest["tables"]):
        raise BundleRefused("tables have plain names")
    return manifest


def inspect_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(table, rows, columns) as a bundle's manifest says, without reading its tables."""
    entries = [(e["table"], e["rows"], ",".join(f["name"] for f in e["schema"]["fields"])) for e in _manifest(spark, path)["tables"]]
    return spark.createDataFrame(entries, "table string, rows long, columns string")


def bundle_problems(spark: SparkSession, path: str, limits: BundleLimits = BundleLimits()) -> DataFrame:
    """(name, problem) of data files that are missing, added, of other bytes or of other content than listed.

    The listing itself must bear the manifest's seal.  All files are read, in parallel.
    """
    told = _manifest(spark, path)
    listing = spark.read.schema(_LISTING).parquet(f"{path}/files")
    if _within(listing, limits) != {k: told.get(k) for k in ("files", "bytes", "seal")}:
        raise BundleRefused("the listing of files is not the manifest's")
    _within(_listed(spark, path, False), limits)  # what lies there, before it is read
    now = _listed(spark, path, True).select("name", F.col("bytes").alias("now_bytes"), F.col("sha256").alias("now_sha"))
    problem = (
        F.when(F.col("now_bytes").isNull(), "missing")
        .when(F.col("bytes").isNull(), "added")
        .when(F.col("bytes") != F.col("now_bytes"), "other size")
        .when(F.col("sha256") != F.col("now_sha"), "other content")
    )
    return listing.join(now, "name", "full").select("name", problem.alias("problem")).where("problem IS NOT NULL")


def _kinds(schema: dict) -> list[tuple[str, str]]:
    return [(f["name"], json.dumps(f["type"], sort_keys=True)) for f in schema["fields"]]


def import_bundle(spark: SparkSession, path: str, limits: BundleLimits = BundleLimits()) -> dict[str, DataFrame]:
    """The tables of a bundle after its files' digests, its counts, names and types of columns are checked against its manifest."""
    bad = bundle_problems(spark, path, limits).orderBy("name").limit(5).collect()
    if bad:
        raise BundleRefused(", ".join(f"{r.name}: {r.problem}" for r in bad))
    out = {}
    for entry in _manifest(spark, path)["tables"]:
        stored = spark.read.parquet(f"{path}/{entry['table']}")
        if _kinds(entry["schema"]) != _kinds(json.loads(stored.schema.json())) or stored.count() != entry["rows"]:
            raise BundleRefused(f"table {entry['table']} is not as the manifest says")
        out[entry["table"]] = stored
    return out
