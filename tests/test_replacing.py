"""Replacement carried out: what is written, what is refused, what a cut-off run leaves."""

import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators.replacing import ImportedSources, ImportRefused

KEYS = ["guid", "tree", "importer"]
ITEMS = "guid string, tree string, importer string, title string"
CHUNKS = "item string, chunk_index int, text string"


def items(spark, n, importer="captions", title="T"):
    return spark.createDataFrame([(f"g{i}", "t", importer, f"{title}{i}") for i in n], ITEMS)


def chunks(spark, n, text="text"):
    return spark.createDataFrame([(f"g{i}", k, f"{text} {i} {k}") for i in n for k in range(1 + i % 3)], CHUNKS)


def files(path):
    return {f"{d[len(path):]}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def texts(store):
    return sorted((r.item, r.chunk_index, r.text) for r in store.chunks().collect())


def test_only_changed_buckets_are_written(spark, tmp_path):
    store = ImportedSources(spark, f"file://{tmp_path}/s", KEYS, 16)
    everything = range(40)
    done = store.run(items(spark, everything), chunks(spark, everything), 1, "a")
    assert {r.action for r in done.collect()} == {"insert"} and store.sources().count() == 40
    before = files(f"{tmp_path}/s")
    assert {r.action for r in store.run(items(spark, everything), chunks(spark, everything, "other"), 1, "b").collect()} == {"skip"}
    assert files(f"{tmp_path}/s") == before and store.outcome("b") == "none"
    old = {r.item: r.source_id for r in store.sources().collect()}
    done = {r.item: r.action for r in store.run(items(spark, [3, 50], title="N"), chunks(spark, [3, 50], "new"), 2, "c").collect()}
    assert done == {"g3": "replace", "g50": "insert"} and store.outcome("c") == "succeeded"
    after = files(f"{tmp_path}/s")
    hit = {r.bucket for r in store.sources().where("item IN ('g3', 'g50')").collect()}
    assert len(hit) <= 2 and all(any(f"bucket={b}/" in f for b in hit) for f in after ^ before)
    now = {r.item: (r.source_id, r.title, r.version) for r in store.sources().collect()}
    assert len(now) == 41 and now["g3"][1:] == ("N3", 2) and now["g3"][0] != old["g3"] and now["g4"][0] == old["g4"]
    want = [x for i in everything if i != 3 for x in [(f"g{i}", k, f"text {i} {k}") for k in range(1 + i % 3)]] + [(f"g{i}", k, f"new {i} {k}") for i in (3, 50) for k in range(1 + i % 3)]
    assert texts(store) == sorted(want)
    assert store._read("chunks").where("source_id IS NOT NULL").count() == len(want)


def test_new_items_leave_the_files_of_others(spark, tmp_path):
    """An import that takes nothing out adds files, and writes no chunk that is there again; a rerun adds no chunk twice."""
    store = ImportedSources(spark, f"file://{tmp_path}/s", KEYS, 2)
    store.run(items(spark, range(6)), chunks(spark, range(6)), 1, "a")
    before = {f for f in files(f"{tmp_path}/s") if "/chunks/" in f}
    store._switch = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        store.run(items(spark, [7, 8]), chunks(spark, [7, 8, 9]), 1, "b")
    assert before < files(f"{tmp_path}/s")
    store = ImportedSources(spark, f"file://{tmp_path}/s", KEYS, 2)
    store.run(items(spark, [7, 8]), chunks(spark, [7, 8, 9]), 1, "b")
    assert store._read("chunks").count() == len(texts(store)) == sum(1 + i % 3 for i in (0, 1, 2, 3, 4, 5, 7, 8))


def test_refusals_write_nothing(spark, tmp_path):
    store = ImportedSources(spark, f"file://{tmp_path}/s", KEYS, 4)
    store.run(items(spark, range(4)), chunks(spark, range(4)), 1, "a")
    before = files(f"{tmp_path}/s")
    cases = [
        (items(spark, [1, 2], "someone"), chunks(spark, [1, 2]), "2 foreign"),
        (items(spark, [1, 1]), chunks(spark, [1]), "1 repeated"),
        (items(spark, [1]), chunks(spark, [1]).limit(0), "1 empty"),
        (items(spark, [2]), spark.createDataFrame([("g2", 0, "  ")], CHUNKS), "1 empty"),
    ]
    for new, parts, why in cases:
        with pytest.raises(ImportRefused, match=why):
            store.run(new, parts, 2, "b")
    twice = store.sources().where("item = 'g1'").withColumn("source_id", F.col("title"))
    store._overwrite("sources", spark.createDataFrame(store.sources().unionByName(twice).collect(), store.sources().schema))
    before = files(f"{tmp_path}/s")
    with pytest.raises(ImportRefused, match="1 conflict"):
        store.run(items(spark, [1]), chunks(spark, [1]), 2, "b")
    assert files(f"{tmp_path}/s") == before and store.outcome("b") == "none"


@pytest.mark.parametrize("step, before, after", [("_prepare", "none", False), ("_switch", "prepared", False), ("_clean", "succeeded", True)])
def test_a_run_cut_off_has_one_outcome(spark, tmp_path, step, before, after):
    """The driver is lost at the begin of each step: readers see all of the old or all of the new, and a rerun ends the import."""
    store = ImportedSources(spark, f"file://{tmp_path}/s", KEYS, 4)
    store.run(items(spark, range(6)), chunks(spark, range(6)), 1, "a")
    held = texts(store)
    broken = ImportedSources(spark, f"file://{tmp_path}/s", KEYS, 4)

    def lost(*_):
        raise RuntimeError("lost")

    setattr(broken, step, lost)
    with pytest.raises(RuntimeError, match="lost"):
        broken.run(items(spark, [1, 5]), chunks(spark, [1, 5], "new"), 2, "b")
    assert store.outcome("b") == before
    new = sorted([x for x in held if x[0] not in ("g1", "g5")] + [(f"g{i}", k, f"new {i} {k}") for i in (1, 5) for k in range(1 + i % 3)])
    assert texts(store) == (new if after else held)
    assert store.resolve("b") == before and texts(store) == (new if after else held)
    assert store._read("chunks").where("source_id IS NOT NULL").count() == len(texts(store))
    store.run(items(spark, [1, 5]), chunks(spark, [1, 5], "new"), 2, "b")
    assert texts(store) == new and store.outcome("b") == "succeeded"
