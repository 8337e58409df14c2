"""The engine as one object: the operations of a knowledge base over a store of tables.

Methods return DataFrames; what decides how a query runs (language policy, notices) comes from
small aggregates.  Sources have identifiers made by rule, so adding one again changes nothing.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import translation
from .functions.text import citation_label, hash_embedding, timestamp_url, tokens_of
from .operators import entities as entity_ops
from .operators import filters, fusion, importloop, ingest, maintenance, retrieval, summary
from .operators.blockindex import BlockIndex
from .runtime import materialise
from .store import Store


class KnowledgeEngine:
    """Sources, chunks, vectors, jobs and entities of one tenant, and search over them.

    Tables hold what was added; searches read the index beside them.  The tables are written first: what a
    lost driver leaves out of the index, ``sync_index`` brings in.  ``ttl`` is how many seconds a search may lag behind
    other writers.
    """

    def __init__(self, spark: SparkSession, root: str, tenant: str = "local", translator: translation.Translator | None = None, ttl: float = 0.0) -> None:
        self.spark, self.tenant = spark, tenant
        self.store = Store(spark, root)
        self.index = BlockIndex(spark, f"{root.rstrip('/')}/index", ttl)
        self.translator = translator or translation.translator("noop")

    def ping(self) -> dict:
        return {"status": "ok", "version": self.store.version()}

    # tables of the tenant

    def _table(self, name: str) -> DataFrame:
        return self.store.table(name).transform(filters.tenant(self.tenant))

    def _sources(self) -> DataFrame:
        return self._table("sources").withColumn("weight", F.coalesce("weight", F.lit(1.0)))

    def _chunks(self) -> DataFrame:
        """Chunks of the tenant's sources, named as the operators name them."""
        held = self._sources().select("source_id", "title", "language", "tree", "weight", F.col("tenant_id").alias("owner"))
        return self._table("chunks").join(held, "source_id").withColumnRenamed("chunk_id", "doc_id")

    # writes

    def ensure_identity(self, user: str = "local") -> None:
        """The tenant and a user of it, if they are not known yet."""
        new = self.spark.createDataFrame([(self.tenant, user)], "tenant_id string, user_id string").withColumn("created_at", F.current_timestamp())
        new = new.join(self.store.table("identities"), ["tenant_id", "user_id"], "left_anti")
        if not new.isEmpty():
            self.store.commit({"identities": new})

    def _add(self, made: dict[str, DataFrame], extra: dict | None = None) -> dict:
        new = made["sources"].join(self._table("sources").select("source_id"), "source_id", "left_anti").collect()
        row = made["sources"].select("source_id").first()
        job = made["jobs"].select("job_id").first()
        if new:
            now = {k: made[k].withColumn("created_at", F.current_timestamp()) for k in ("sources", "embeddings", "jobs")}
            self.store.commit({"sources": now["sources"], "chunks": made["chunks"], "embeddings": now["embeddings"], "jobs": now["jobs"], **(extra or {})})
            self.index.append(self._indexed([row.source_id]))
        return {"source_id": row.source_id, "job_id": job.job_id, "status": "added" if new else "present"}

    def add_text_source(self, title: str, text: str, collection_id: str | None = None) -> dict:
        self.ensure_identity()
        rows = self.spark.createDataFrame([(title, text, collection_id)], "title string, text string, collection_id string")
        return self._add(ingest.notes(rows, self.tenant))

    def add_transcript_source(self, payload: dict) -> dict:
        """A transcript: show_title, episode_title, episode_url, language, segments, metadata, entities."""
        self.ensure_identity()
        segments = [(s.get("start_ms"), s.get("end_ms"), s["text"]) for s in payload["segments"]]
        kind = "show_title string, episode_title string, episode_url string, language string, segments array<struct<start_ms:long,end_ms:long,text:string>>"
        rows = self.spark.createDataFrame([(payload["show_title"], payload["episode_title"], payload.get("episode_url"), payload.get("language"), segments)], kind)
        made = ingest.transcripts(rows, self.tenant)
        given = payload.get("metadata") or {}
        told = {"show_title": payload["show_title"], "input_type": "transcript", **given}
        weight = given.get("retrieval_weight", 1.0)
        extra = {
            "show": told["show_title"], "url": payload.get("episode_url"), "tree": given.get("source_tree_slug"),
            "weight": _positive(weight), "preference": given.get("preference_label"), "metadata": _json(told),
        }
        sources = made["sources"]
        for name, value in extra.items():
            sources = sources.withColumn(name, F.lit(value))
        made = {**made, "sources": sources}
        return self._add(made, self._links(made["sources"], payload.get("entities") or []))

    def _links(self, sources: DataFrame, payload: list[dict]) -> dict[str, DataFrame]:
        kind = "type string, slug string, entity_label string, label string, name string, role string"
        rows = [tuple(None if e.get(k) is None else str(e[k]) for k in ("type", "slug", "entity_label", "label", "name", "role")) for e in payload]
        raw = self.spark.createDataFrame(rows, kind).crossJoin(F.broadcast(sources.select(F.col("source_id").alias("doc_id"))))
        links = entity_ops.normalise(raw)
        new = entity_ops.upsert(self._table("entities"), links).withColumn("tenant_id", F.lit(self.tenant))
        known = self._table("aliases").select("slug", "alias")
        aliases = links.where("label IS NOT NULL").select("slug", F.col("label").alias("alias")).distinct().join(known, ["slug", "alias"], "left_anti")
        held = self._table("source_entities").withColumnRenamed("source_id", "doc_id")
        attached = entity_ops.attach(held, links).withColumnRenamed("doc_id", "source_id").withColumn("tenant_id", F.lit(self.tenant))
        return {"entities": new, "aliases": aliases.withColumn("tenant_id", F.lit(self.tenant)), "source_entities": attached} if rows else {}

    def import_transcripts(
        self, items: DataFrame, contents: DataFrame, show: str, kind: str = "Published", limit: int | None = None, count_skips: bool = True, numbers: tuple[int | None, int | None] = (None, None)
    ) -> DataFrame:
        """Import a listing's transcripts (``importloop.import_loop``); returns a row for each item with its status and reason.

        ``contents``: guid, content, url, mime, seconds.  Sources, chunks, vectors, jobs and the state of
        items of this ``kind`` (Published or Generated) change in one commit, so a run that is cut off has done nothing.
        """
        weight, label = (1.0, "published") if kind == "Published" else (0.9, "generated")
        state = self._table("items")
        mine = state.where(F.col("kind") == kind)
        named = items.withColumn("title", importloop.source_title(show, F.col("title"), kind))
        loop = importloop.import_loop(named, mine, self._sources().select("source_id", "title", "url"), importloop.read_transcripts(contents), show, self.tenant, limit, count_skips, numbers)
        results = materialise(loop.results, "import-results")
        told = F.to_json(F.struct(F.lit(show).alias("show_title"), F.lit(f"podcast_{kind.lower()}_transcript").alias("input_type")))
        sources = loop.made["sources"].withColumn("weight", F.lit(weight)).withColumn("preference", F.lit(label)).withColumn("metadata", told)
        now = {"sources": sources, "embeddings": loop.made["embeddings"], "jobs": loop.made["jobs"]}
        added = {**{k: v.withColumn("created_at", F.current_timestamp()) for k, v in now.items()}, "chunks": loop.made["chunks"]}
        after = importloop.next_state(mine, results).withColumn("kind", F.lit(kind)).withColumn("tenant_id", F.lit(self.tenant))
        rest = self.store.table("items").where(~(F.col("tenant_id").eqNullSafe(self.tenant) & F.col("kind").eqNullSafe(kind)))
        self.store.commit(added, {"items": rest.unionByName(after)})
        self.index.append(self._indexed(results.where("status = 'imported'").select("source_id")))
        return results

    def _indexed(self, source_ids: list[str] | DataFrame | None = None) -> DataFrame:
        """Chunks as the index takes them, of some sources or of all tenants' sources."""
        sources, chunks = self.store.table("sources"), self.store.table("chunks").select("source_id", "chunk_id", "text")
        if isinstance(source_ids, DataFrame):
            sources, chunks = sources.join(source_ids, "source_id", "left_semi"), chunks.join(source_ids, "source_id", "left_semi")
        elif source_ids is not None:
            sources, chunks = sources.where(F.col("source_id").isin(*source_ids)), chunks.where(F.col("source_id").isin(*source_ids))
        linked = self.store.table("source_entities").groupBy("source_id").agg(F.collect_set("slug").alias("entities"))
        sources = sources.select("source_id", "title", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.col("tenant_id").alias("tenant"), "language", "tree").join(linked, "source_id", "left")
        vectors = self.store.table("embeddings").where(F.col("model") == ingest.HASH_MODEL).select("chunk_id", "vector")
        return chunks.join(sources, "source_id").join(vectors, "chunk_id", "left").withColumnRenamed("chunk_id", "doc_id")

    def sync_index(self) -> dict:
        """Bring the index to what the tables hold; how many chunks were added and taken out."""
        self.index.refresh(force=True)
        held, wanted = self.index.holds(), self._indexed()
        removed = self.index.delete(held.join(wanted.select("doc_id"), "doc_id", "left_anti")) if self.index.state["segments"] else 0
        return {"removed": removed, "added": self.index.append(wanted.join(held.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "left_anti"))}

    def set_source_preference(self, source_id: str, weight: float, label: str | None = None) -> dict:
        if not weight > 0:
            raise ValueError("a weight is positive")
        if self._source(source_id) is None:
            raise KeyError(source_id)
        hit = (F.col("source_id") == source_id) & (F.col("tenant_id") == self.tenant)
        rows = self.store.table("sources").withColumn("weight", F.when(hit, F.lit(float(weight))).otherwise(F.col("weight")))
        if label is not None:
            rows = rows.withColumn("preference", F.when(hit, F.lit(label)).otherwise(F.col("preference")))
        self.store.commit(replaced={"sources": rows})
        self.index.replace(self._indexed([source_id]))
        return {"source_id": source_id, "weight": float(weight), "preference": label}

    def delete_source(self, source_id: str) -> bool:
        """Delete a source and all that hangs on it; False if the tenant has no such source."""
        if self._source(source_id) is None:
            return False
        gone = self.spark.createDataFrame([(source_id,)], "source_id string")
        self.index.delete(self._table("chunks").where(F.col("source_id") == source_id).select(F.col("chunk_id").alias("doc_id")))
        names = ["embeddings", "source_entities", "chunks", "jobs", "sources"]
        self.store.commit(replaced=maintenance.delete_sources({n: self.store.table(n) for n in names}, gone, "source_id"))
        return True

    # bundles

    def export(self, path: str) -> None:
        """All tables as a bundle whose files bear digests."""
        settings = {"embedding_model": ingest.HASH_MODEL, "version": self.store.version()}
        maintenance.export_bundle({n: self.store.table(n) for n in self.store.schemas}, path, settings)

    def restore(self, path: str) -> dict[str, int]:
        """Fill an empty corpus from a bundle after its digests are checked, in one commit; rows by table."""
        if self.store.version() > 0:
            raise ValueError("a bundle is restored into an empty corpus only")
        tables = maintenance.import_bundle(self.spark, path)
        unknown = sorted(set(tables) - set(self.store.schemas))
        if unknown:
            raise maintenance.BundleRefused(f"not tables of a corpus: {unknown}")
        self.store.commit(tables)
        self.sync_index()
        return {n: rows.count() for n, rows in tables.items()}

    # listings

    def _source(self, source_id: str):
        return self._sources().where(F.col("source_id") == source_id).first()

    def list_sources(self, limit: int = 50) -> DataFrame:
        return self._sources().orderBy(F.desc("created_at"), F.desc("source_id")).limit(limit)

    def list_ingestion_jobs(self, limit: int = 50, source_id: str | None = None) -> DataFrame:
        """The newest jobs, of one source if it is named."""
        rows = self._table("jobs")
        rows = rows if source_id is None else rows.where(F.col("source_id") == source_id)
        return rows.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)

    def get_ingestion_job_status(self, job_id: str) -> DataFrame:
        return self._table("jobs").where(F.col("job_id") == job_id).limit(1)

    def list_entities(self) -> DataFrame:
        return entity_ops.listed(self._table("entities"))

    def get_source_entities(self, source_id: str) -> DataFrame:
        return entity_ops.listed_of(self._table("source_entities").where(F.col("source_id") == source_id), self._table("entities"))

    # search

    def _counts(self) -> dict[str | None, int]:
        return {r.language: r.n for r in retrieval.language_counts(self._sources()).collect()}

    def _vector(self, text: str) -> list[float]:
        return list(self.spark.range(1).select(hash_embedding(F.lit(text)).alias("v")).first().v)

    def _ranked(self, query: str, limit: int, mode: str, entity_slugs, source_tree_slug, language_policy, language, query_translated) -> DataFrame:
        found = retrieval.detected(self.spark, query)
        decision = retrieval.decide(self._counts(), language_policy, language, found)
        if query_translated is None and translation.fallback(query, found, self.translator) not in (None, query):
            query_translated = translation.fallback(query, found, self.translator)
        texts = [query] + ([query_translated] if query_translated and query_translated.casefold() != query.casefold() else [])
        if mode not in retrieval.MODES:
            raise ValueError(f"mode is one of {', '.join(retrieval.MODES)}")
        kept: dict[str, list] = {"tenant": [self.tenant]}
        if decision.language is not None:
            kept["language"] = [decision.language, *([None] if decision.undetermined else [])]
        if source_tree_slug is not None:
            kept["tree"] = [source_tree_slug]
        if entity_slugs:
            # entities by slug, with their type if it is named; unknown ones are ignored unless all are
            asked = self.spark.createDataFrame([(e,) for e in entity_slugs], "slug string")
            kept["entity"] = [r.slug for r in entity_ops.resolved(asked, self._table("entities")).collect()]
        most = limit if len(texts) == 1 else 2 * limit
        titles = self._chunks().select("doc_id", "title")

        def one(text: str) -> DataFrame:
            if mode == "keyword":
                return self.index.search(text, most, kept)
            if mode == "vector":
                return self.index.nearest(self._vector(text), most, kept)
            return fusion.fuse([self.index.search(text, 2 * most, kept), self.index.nearest(self._vector(text), 2 * most, kept)], most, titles)

        runs = [one(t) for t in texts]
        return runs[0] if len(runs) == 1 else fusion.fuse(runs, limit, titles)

    def search_knowledge(
        self, query: str, limit: int = 10, mode: str = "hybrid", entity_slugs: list[str] | None = None, source_tree_slug: str | None = None,
        language_policy: str = "auto", language: str | None = None, query_translated: str | None = None,
    ) -> DataFrame:
        """Ranked chunks with their text, citation and links."""
        ranked = self._ranked(query, limit, mode, entity_slugs, source_tree_slug, language_policy, language, query_translated)
        rows = self._chunks().drop("title", "language", "tree", "weight").join(F.broadcast(ranked), "doc_id")
        rows = rows.join(self._sources().select("source_id", "title", "url", "show", "source_type"), "source_id")
        return rows.select(
            F.expr("row_number() OVER (ORDER BY round(score, 9) DESC, title, doc_id)").alias("rank"),
            F.col("doc_id").alias("chunk_id"), "source_id", "title", "text", "score", "start_ms", "end_ms", F.col("url").alias("source_url"),
            citation_label(F.col("source_type"), F.col("show"), F.lit(None).cast("string"), F.col("title"), F.col("start_ms"), F.col("chunk_index")).alias("citation_label"),
            timestamp_url(F.col("source_type"), F.col("url"), F.col("start_ms")).alias("timestamp_url"),
        )

    def query_language_notice(self, query: str) -> dict | None:
        return retrieval.notice(self._counts(), len(tokens_of(query)), retrieval.detected(self.spark, query))

    def retrieve_context_pack(self, query: str, limit: int = 8, mode: str = "hybrid", query_language: str | None = None, translate_quotes: bool = False, **how) -> dict:
        """Evidence for an answer: verbatim chunks with citations, the language to answer in, a notice."""
        answer = translation.response_language(query_language, retrieval.detected(self.spark, query))
        # at most ``limit`` rows
        chunks = [r.asDict() for r in self.search_knowledge(query, limit, mode, **how).orderBy("rank").collect()]
        if translate_quotes:
            for c in chunks:
                c["text_translated"] = self.translator.translate(c["text"], answer or "en")
                c["translation_provenance"] = {"model": self.translator.model, "target_language": answer or "en"}
        return {"query": query, "mode": mode, "chunks": chunks, "response_language": answer, "response_language_directive": translation.directive(answer), "notice": self.query_language_notice(query)}

    # whole sources

    def resolve_source(self, query: str, preference: str = "current") -> DataFrame:
        """The one source that a question about a whole source means."""
        return summary.resolve(self._sources().withColumn("doc_id", F.col("source_id")), query, preference).drop("doc_id")

    def get_source_summary_context(self, source_id: str, max_chunks: int | None = None) -> DataFrame:
        """The source's chunks in order, with links; no rows for an unknown source."""
        rows = self._table("chunks").where(F.col("source_id") == source_id).join(self._sources().select("source_id", "title", "url", "source_type"), "source_id")
        if max_chunks is not None:
            rows = rows.orderBy("chunk_index").limit(max_chunks)
        rows = rows.withColumn("timestamp_url", timestamp_url(F.col("source_type"), F.col("url"), F.col("start_ms")))
        return rows.select("source_id", "title", "chunk_id", "chunk_index", "text", "start_ms", "end_ms", "timestamp_url").orderBy("chunk_index")

    def resolve_summary_context(self, query: str, preference: str = "current", max_chunks: int | None = None) -> DataFrame | None:
        best = self.resolve_source(query, preference).first()
        return None if best is None else self.get_source_summary_context(best.source_id, max_chunks)


def _positive(weight) -> float:
    try:
        value = float(weight)
    except (TypeError, ValueError):
        return 1.0
    return value if value > 0 and math.isfinite(value) else 1.0


def _json(value: dict) -> str:
    return json.dumps(value, sort_keys=True)
