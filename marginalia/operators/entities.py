"""People and organisations linked to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify


def entity_type(raw: Column) -> Column:
    """person or organization (also ``org``); null for anything else."""
    kind = F.lower(F.trim(raw))
    return F.when(kind.isin("organization", "org"), "organization").when(kind == "person", "person")


def normalise(payload: DataFrame) -> DataFrame:
    """(doc_id, entity_type, slug, label, role) of raw links; those without a valid type or slug go.

    ``slug`` may be ``type:slug``, which then names the type as well.  The label falls back
    from entity_label to label to name.
    """
    parts = F.split("slug", ":", 2)
    typed = F.size(parts) == 2
    rows = payload.select(
        "doc_id",
        F.when(typed, entity_type(parts[0])).otherwise(entity_type(F.col("type"))).alias("entity_type"),
        slugify(F.when(typed, F.get(parts, F.lit(1))).otherwise(F.col("slug"))).alias("slug"),
        F.coalesce(F.nullif("entity_label", F.lit("")), F.nullif("label", F.lit("")), F.nullif("name", F.lit(""))).alias("label"),
        F.coalesce("role", F.lit("related")).alias("role"),
    )
    return rows.where("entity_type IS NOT NULL AND slug <> ''")


def upsert(known: DataFrame, links: DataFrame) -> DataFrame:
    """New entities (slug, entity_type, label): one for each unknown slug, the least label.

    A slug that comes with another type than it has is an error.
    """
    new = links.groupBy("slug").agg(F.min("entity_type").alias("entity_type"), F.max("entity_type").alias("other"), F.min("label").alias("label"))
    seen = known.select("slug", F.col("entity_type").alias("kept"))
    both = new.join(seen, "slug", "left")
    clash = (F.col("entity_type") != F.col("other")) | (F.col("kept").isNotNull() & (F.col("kept") != F.col("entity_type")))
    fail = F.raise_error(F.concat(F.lit("entity has two types: "), "slug")).cast("boolean")
    return both.where(F.when(clash, fail).otherwise(F.col("kept").isNull())).select("slug", "entity_type", "label")


def attach(existing: DataFrame, links: DataFrame) -> DataFrame:
    """Links (doc_id, slug, role) that are not there yet, once each."""
    keys = ["doc_id", "slug", "role"]
    return links.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def listed(entities: DataFrame) -> DataFrame:
    """(type, slug, label) of all entities, by type and slug."""
    return entities.select(F.col("entity_type").alias("type"), "slug", "label").orderBy("type", "slug")


def listed_of(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(type, slug, label, role) of linked entities, by type, slug and role."""
    rows = links.select("slug", "role").join(entities.select("slug", "entity_type", "label"), "slug")
    return rows.select(F.col("entity_type").alias("type"), "slug", "label", "role").orderBy("type", "slug", "role")


def resolved(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(slug) of the entities that ``slug`` or ``type:slug`` names; unknown ones are left out."""
    parts = F.split("slug", ":", 2)
    typed = F.size(parts) == 2
    named = asked.select(F.when(typed, entity_type(parts[0])).alias("kind"), slugify(F.when(typed, F.get(parts, F.lit(1))).otherwise(F.col("slug"))).alias("wanted"), typed.alias("typed"))
    fits = (F.col("slug") == F.col("wanted")) & (~F.col("typed") | (F.col("entity_type") == F.col("kind")))
    return entities.join(F.broadcast(named), fits, "left_semi").select("slug")


#: Entities that a corpus may begin with (plain examples; a parameter of ``seed``).
EXAMPLES = [("organization", "example-press", "Example Press"), ("person", "jane-doe", "Jane Doe")]


def seed(spark: SparkSession, rows: list[tuple[str, str, str]] = EXAMPLES) -> DataFrame:
    """(entity_type, slug, label) of a few known entities."""
    return spark.createDataFrame(rows, "entity_type string, slug string, label string")
