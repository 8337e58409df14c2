"""The engine object end to end, and its store and translators."""

import pytest

from marginalia.engine import KnowledgeEngine
from marginalia.functions import translation
from marginalia.store import Store


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    engine = KnowledgeEngine(spark, f"file://{tmp_path_factory.mktemp('store')}")
    engine.add_text_source("Cats", "The cat sat on the mat and the cats were happy with it.\n\nAnother paragraph about kittens.")
    engine.add_text_source("Dogs", "The dog ran to the river and it was cold there.")
    engine.add_transcript_source(
        {
            "show_title": "Show", "episode_title": "Episode 7: rivers", "episode_url": "https://e.org/7", "language": "en",
            "segments": [{"start_ms": 0, "end_ms": 5000, "text": "A river is long."}, {"start_ms": 65000, "end_ms": 70000, "text": "The dog swims in the river."}],
            "metadata": {"retrieval_weight": "2.0", "source_tree_slug": "show", "preference_label": "current"},
            "entities": [{"type": "person", "slug": "Jane Doe", "label": "Jane"}, {"type": "odd", "slug": "x"}],
        }
    )
    return engine


def test_sources_jobs_and_entities(engine):
    assert engine.ping()["status"] == "ok"
    assert {r.title for r in engine.list_sources().collect()} == {"Cats", "Dogs", "Episode 7: rivers"}
    again = engine.add_text_source("Dogs", "The dog ran to the river and it was cold there.")
    assert again["status"] == "present" and engine.list_sources().count() == 3
    jobs = engine.list_ingestion_jobs(source_id=again["source_id"]).collect()
    assert [j.job_id for j in jobs] == [again["job_id"]] and engine.get_ingestion_job_status(again["job_id"]).first().status == "succeeded"
    assert [tuple(r) for r in engine.list_entities().collect()] == [("person", "jane-doe", "Jane")]
    show = engine.list_sources().where("show = 'Show'").first()
    assert (show.weight, show.tree, show.preference) == (2.0, "show", "current")
    assert [tuple(r) for r in engine.get_source_entities(show.source_id).collect()] == [("person", "jane-doe", "Jane", "related")]


def test_search(engine):
    for mode in ("keyword", "vector", "hybrid"):
        rows = engine.search_knowledge("dog river", 3, mode, language_policy="any").orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and (rows or mode == "vector")
    best = engine.search_knowledge("dog river", 3, "keyword").orderBy("rank").first()
    assert best.text == "The dog swims in the river." and best.timestamp_url == "https://e.org/7?t=65" and best.citation_label == "Show, Episode 7: rivers, 01:05"
    assert engine.search_knowledge("dog", 5, "keyword", source_tree_slug="show").count() == 1
    assert engine.search_knowledge("dog", 5, "keyword", entity_slugs=["person:jane-doe", "nobody"]).count() == 1
    assert engine.search_knowledge("dog", 5, "keyword", entity_slugs=["nobody"]).count() == 0
    with pytest.raises(ValueError):
        engine.search_knowledge("dog", mode="other")
    with pytest.raises(ValueError):
        engine.search_knowledge("dog", language_policy="other")


def test_searches_open_the_index(engine):
    for mode in ("keyword", "vector"):
        plan = engine._ranked("dog river", 3, mode, None, "show", "any", None, None)._jdf.queryExecution().executedPlan().toString()
        assert ("/index/postings" if mode == "keyword" else "/index/vectors") in plan and "/chunks/" not in plan
    # what a lost driver left out of the index comes back
    held = engine.index.holds()
    n = held.count()
    assert engine.index.delete(held.limit(1)) == 1 and engine.sync_index() == {"removed": 0, "added": 1} and engine.index.holds().count() == n


def test_context_pack(engine):
    pack = engine.retrieve_context_pack("where is the dog and what does the river do", 2, "keyword", translate_quotes=True)
    assert pack["response_language"] == "en" and "'en'" in pack["response_language_directive"] and pack["notice"] is None
    assert len(pack["chunks"]) == 2 and all(c["text_translated"] == c["text"] for c in pack["chunks"])
    assert engine.retrieve_context_pack("что говорит книга об исходе", 2)["notice"]["query_language"] == "ru"


def test_whole_sources(engine):
    best = engine.resolve_source("episode 7").first()
    assert best.title == "Episode 7: rivers"
    rows = engine.resolve_summary_context("episode 7").collect()
    assert [r.chunk_index for r in rows] == [1, 2] and rows[1].timestamp_url.endswith("t=65")
    assert engine.get_source_summary_context(best.source_id, 1).count() == 1
    assert engine.resolve_summary_context("zzz") is None and engine.get_source_summary_context("none").count() == 0


def test_preference_and_delete(spark, tmp_path):
    engine = KnowledgeEngine(spark, f"file://{tmp_path}/s")
    a, b = (engine.add_text_source(t, "the same words are in both of them")["source_id"] for t in ("A", "B"))
    with pytest.raises(ValueError):
        engine.set_source_preference(a, 0)
    with pytest.raises(KeyError):
        engine.set_source_preference("none", 1.0)
    engine.set_source_preference(b, 3.0, "current")
    assert engine.search_knowledge("same words", 2, "keyword").orderBy("rank").first().source_id == b
    other = KnowledgeEngine(spark, f"file://{tmp_path}/s", tenant="other")
    assert other.list_sources().count() == 0 and other.search_knowledge("same words", 2, "keyword").count() == 0 and not other.delete_source(a)
    assert engine.delete_source(a) and not engine.delete_source(a)
    assert [r.source_id for r in engine.list_sources().collect()] == [b]
    assert all(engine.store.table(n).where(f"source_id = '{a}'").isEmpty() for n in ("chunks", "embeddings", "jobs"))


def test_a_commit_is_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/t", {"a": "x long", "b": "y string"})
    one = spark.createDataFrame([(1,)], "x long")
    assert store.table("a").count() == 0 and store.version() == 0
    store.commit({"a": one})
    with pytest.raises(Exception):
        store.commit({"a": one, "b": spark.createDataFrame([("z",)], "y string").selectExpr("raise_error('no') AS y")})
    assert store.table("a").count() == 1 and store.version() == 1
    store.commit({"a": one}, {"b": spark.createDataFrame([("z", 1)], "y string, more int")})
    assert store.table("a").count() == 2 and store.table("b").columns == ["y"] and store.compact("a") == 3


def test_translators():
    calls = []

    class Loud:
        model = "loud"

        def translate(self, text, target):
            calls.append(text)
            return text.upper() + target

    held = translation.Remembered(Loud(), 1)
    assert held.translate("a", "en") == "Aen" == held.translate("a", "en") and calls == ["a"]
    held.translate("b", "en")
    held.translate("a", "en")
    assert calls == ["a", "b", "a"]
    book = translation.translator("phrasebook", {("hola", "en"): "hello"})
    assert translation.fallback("hola", ("es", 0.9), book) == "hello" and translation.fallback("adios", ("es", 0.9), book) is None
    assert translation.fallback("hola", ("es", 0.3), book) is None and translation.fallback("hello", ("en", 0.9), book) is None
    with pytest.raises(ValueError):
        translation.translator("remote")
    assert translation.response_language("fr", ("en", 1.0)) == "fr" and translation.response_language(None, ("en", 0.2)) is None
