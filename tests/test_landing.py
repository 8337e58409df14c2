"""The stream of notes: failures between tables, batches given twice, new checkpoints, what the engine sees."""

import json

import pytest

from marginalia.engine import KnowledgeEngine
from marginalia.store import Store
from marginalia.streaming import landing


def land(folder, name, *titles):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"title": t, "text": f"The text of {t} is about rivers.", "collection_id": None}) for t in titles]
    (folder / f"{name}.json").write_text("\n".join(lines) + "\n")


def rows(store):
    return {n: store.table(n).count() for n in ("sources", "chunks", "embeddings", "jobs")}


def test_a_failure_between_two_tables_leaves_nothing_and_is_made_good(spark, tmp_path, monkeypatch):
    land(tmp_path / "in", "a", "One", "Two")
    args = (spark, f"{tmp_path}/in", f"file://{tmp_path}/corpus", f"{tmp_path}/ck")
    store, whole = Store(spark, args[2]), Store.commit

    def halfway(self, appended=None, replaced=None):
        # sources and chunks are written, then the run is lost
        first = {n: appended[n] for n in ("sources", "chunks")}
        for n, r in first.items():
            r.write.parquet(f"{self.root}/{n}/lost")
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "commit", halfway)
    with pytest.raises(Exception, match="lost"):
        landing.ingest_notes(*args).awaitTermination()
    assert rows(store) == {"sources": 0, "chunks": 0, "embeddings": 0, "jobs": 0}
    monkeypatch.setattr(Store, "commit", whole)
    landing.ingest_notes(*args).awaitTermination()
    assert rows(store) == {"sources": 2, "chunks": 2, "embeddings": 2, "jobs": 2}
    recorded = store.table("batches").collect()
    assert len(recorded) == 1 and recorded[0].stream != args[3]
    # a note of before beside a new one
    land(tmp_path / "in", "b", "Two", "Three")
    landing.ingest_notes(*args).awaitTermination()
    assert rows(store) == {"sources": 3, "chunks": 3, "embeddings": 3, "jobs": 3} and store.table("batches").count() == 2
    # a new checkpoint counts batches from 0 again, under another identity
    land(tmp_path / "in2", "c", "Four")
    landing.ingest_notes(spark, f"{tmp_path}/in2", args[2], f"{tmp_path}/ck2").awaitTermination()
    assert rows(store)["sources"] == 4
    engine = KnowledgeEngine(spark, args[2])
    assert {r.title for r in engine.list_sources().collect()} == {"One", "Two", "Three", "Four"}
    assert engine.sync_index() == {"removed": 0, "added": 4}
    assert engine.search_knowledge("rivers", 10, "keyword", language_policy="any").count() == 4


def test_a_batch_given_again_after_its_commit_adds_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/corpus")
    part = spark.createDataFrame([("A", "hello there", None)], "title string, text string, collection_id string")
    other = spark.createDataFrame([("B", "hello again", None)], "title string, text string, collection_id string")
    assert landing.take_batch(store, part, "s", 0) and not landing.take_batch(store, other, "s", 0)
    assert landing.take_batch(store, part, "s", 1) and landing.take_batch(store, other, "s2", 0)
    assert rows(store) == {"sources": 2, "chunks": 2, "embeddings": 2, "jobs": 2}
    assert landing.take_batch(store, part.limit(0), "s", 2) and store.table("batches").count() == 4
