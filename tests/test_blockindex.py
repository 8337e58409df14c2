"""The index that grows by segments, against a scan and against a rebuild."""

import os
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import blockindex, keyword, vector
from marginalia.operators.blockindex import BlockIndex

WORDS = [f"w{i}" for i in range(40)]
SCHEMA = "doc_id long, text string, title string, weight double, tenant string, language string, tree string, entities array<string>, vector array<double>"


def documents(seed, ids):
    rnd = random.Random(seed)
    out = []
    for i in ids:
        text = " ".join(rnd.choices(WORDS, weights=[2.0 ** (-k / 4) for k in range(40)], k=rnd.randint(1, 60)))
        out.append(
            (
                i, rnd.choice([text, text, text, text, "", None]) if i % 9 == 0 else text, f"T{i % 5}", 1.0 + i % 3, rnd.choice(["one", "two"]),
                rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), rnd.sample(["x", "y", "z"], rnd.randint(0, 2)),
                None if i % 7 == 0 else [rnd.gauss(0, 1) for _ in range(4)],
            )
        )
    return out


def scanned(spark, rows, query, filters=None, limit=10):
    frame = spark.createDataFrame([r for r in rows if passes(r, filters or {})], SCHEMA)
    return [(r.doc_id, round(r.score, 8)) for r in keyword.search(frame, query, limit).collect()]


def passes(row, filters):
    own = {"tenant": [row[4]], "language": [row[5]], "tree": [row[6]], "entity": row[7]}
    return all(set(own[f]) & set(values) for f, values in filters.items())


def found(index, query, filters=None, limit=10, **how):
    return [(r.doc_id, round(r.score, 8)) for r in index.search(query, limit, filters, **how).collect()]


FILTERS = [
    None, {"tenant": ["one"]}, {"language": ["de", None]}, {"language": ["en"], "tree": ["a"], "tenant": ["two"]}, {"entity": ["x", "z"]}, {"tree": [None]}, {"entity": ["nobody"]},
]


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    rows = documents(1, range(700))
    index = BlockIndex(spark, f"file://{tmp_path_factory.mktemp('blocks')}", direct=0)
    assert index.append(spark.createDataFrame(rows, SCHEMA)) == 700
    return rows, index


@pytest.mark.parametrize("filters", FILTERS)
def test_ranks_of_the_scan_under_every_filter(spark, held, filters):
    rows, index = held
    for query in ("w0", "w3 w39 w1", "w30 w31 w0 w0", "none", "!!"):
        assert found(index, query, filters) == scanned(spark, rows, query, filters), query
    query = [0.3, -1.0, 0.5, 0.2]
    kept = spark.createDataFrame([r for r in rows if r[8] and passes(r, filters or {})], SCHEMA).select("doc_id", "weight", "vector")
    want = [(r.doc_id, round(r.score, 8)) for r in vector.search(kept, query).collect()]
    assert [(r.doc_id, round(r.score, 8)) for r in index.nearest(query, 10, filters).collect()] == want


def test_global_statistics_and_the_classic_formula(spark, held):
    rows, index = held
    frame = spark.createDataFrame(rows, SCHEMA)
    own = frame.where("language = 'de'")
    want = [(r.doc_id, round(r.score, 8)) for r in keyword.search(own, "w2 w9", corpus=frame).collect()]
    assert found(index, "w2 w9", {"language": ["de"]}, scope="global") == want
    assert len(found(index, "w2 w9", formula="fts")) == 10
    with pytest.raises(ValueError):
        index.search("w1", filters={"colour": ["red"]})
    with pytest.raises(ValueError):
        index.search("w1", scope="other")


def test_blocks_left_out(spark, tmp_path):
    """A frequent word's blocks are read where they can hold one of the best, and the same ten come out."""
    rows = documents(4, range(6000))
    index = BlockIndex(spark, f"file://{tmp_path}/i", direct=0)
    index.append(spark.createDataFrame(rows, SCHEMA))
    every = BlockIndex(spark, f"file://{tmp_path}/i")
    for query, most in (("w0", 0.4), ("w39 w0", 0.7)):
        plan = index.plan(query)
        assert plan.read < most * plan.blocks, (query, plan.read, plan.blocks)
        assert found(index, query) == found(every, query) == scanned(spark, rows, query)
    assert every.plan("w0").windows is None


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_append_and_delete_equal_a_rebuild(spark, tmp_path):
    rows = documents(2, range(4000))
    more, gone = documents(3, range(4000, 4040)), set(range(0, 4000, 100))
    path = f"{tmp_path}/i"
    index = BlockIndex(spark, f"file://{path}")
    index.append(spark.createDataFrame(rows, SCHEMA))
    whole = size_of(path)
    index.append(spark.createDataFrame(more, SCHEMA))
    assert index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long")) == len(gone)
    assert index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long")) == 0
    assert size_of(path) - whole < 0.2 * whole
    left = [r for r in rows if r[0] not in gone] + more
    rebuilt = BlockIndex(spark, f"file://{tmp_path}/again")
    rebuilt.append(spark.createDataFrame(left, SCHEMA))
    queries = [("w0 w17", None), ("w38 w2", {"language": ["de", None]}), ("w5", {"entity": ["y"], "tenant": ["one"]})]
    for query, filters in queries:
        assert found(index, query, filters) == found(rebuilt, query, filters) == scanned(spark, left, query, filters)
    assert (index.state["n"], index.state["total"]) == (rebuilt.state["n"], rebuilt.state["total"])
    index.merge()
    assert len(index.state["segments"]) == 1 and not index.state["deleted"] and index.holds().count() == len(left)
    for query, filters in queries:
        assert found(index, query, filters) == found(rebuilt, query, filters)
    index.replace(spark.createDataFrame([(7, "w0 zebra", "T", 1.0, "one", "en", "a", [], None)], SCHEMA))
    assert [d for d, _ in found(index, "zebra")] == [7] and index.holds().where("doc_id = 7").count() == 1


def test_small_segments_merge_by_tiers(spark, tmp_path):
    index = BlockIndex(spark, f"file://{tmp_path}/i")
    for i in range(blockindex.FAN):
        index.append(spark.createDataFrame(documents(i, [i]), SCHEMA))
    assert len(index.state["segments"]) == 1 and index.state["n"] == blockindex.FAN
    assert index.append(spark.createDataFrame([], SCHEMA)) == 0
    assert index.delete(index.holds()) == blockindex.FAN and found(index, "w0") == []
    index.merge()
    assert index.state["segments"] == [] and found(index, "w0") == []
    with pytest.raises(Exception):
        index.append(spark.createDataFrame([(1, "a", 0.0)], "doc_id long, text string, weight double"))
    assert index.append(spark.createDataFrame([("key", "w0")], "doc_id string, text string")) == 1
    with pytest.raises(ValueError):
        index.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))


def test_an_open_index_takes_up_only_what_changed(spark, tmp_path):
    """After the time to live a held index opens the new segment and keeps the others; before it, and at an unchanged version, nothing is opened."""
    path = f"file://{tmp_path}/i"
    writer = BlockIndex(spark, path)
    writer.append(spark.createDataFrame(documents(1, range(50)), SCHEMA))
    slow, quick = BlockIndex(spark, path, ttl=1e9), BlockIndex(spark, path, ttl=0.0, hold=True)
    opened = []
    plain = BlockIndex._read
    quick._read = lambda name, segment: opened.append(segment) or plain(quick, name, segment)
    assert not quick.refresh() and opened == []
    first = writer.state["segments"][0]["id"]
    writer.append(spark.createDataFrame([(99, "zebra", "T", 100.0, "one", "en", "a", [], [9.0, 0.0, 0.0, 0.0])], SCHEMA))
    assert found(slow, "zebra") == []
    assert [d for d, _ in found(quick, "zebra")] == [99] and set(opened) == {writer.state["segments"][1]["id"]} and first in quick._open
    assert quick.nearest([1.0, 0.0, 0.0, 0.0], 1).first().doc_id == 99


def test_a_second_writer_of_the_same_version_fails(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    BlockIndex(spark, path).append(spark.createDataFrame(documents(1, range(5)), SCHEMA))
    stale = BlockIndex(spark, path)
    BlockIndex(spark, path).append(spark.createDataFrame(documents(1, range(5, 9)), SCHEMA))
    with pytest.raises(Exception):
        stale._commit(n=0)
    assert BlockIndex(spark, path).state["n"] == 9


def test_heads_are_read_without_entries(spark, held):
    _, index = held
    plan = index._of(["w1"]).select("token", "window", "bits")._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in plan.split("ReadSchema")[1] and "bucket" in plan
    assert index.search("w1", filters={"tenant": ["one"]}).select(F.col("doc_id")).count() == 10


def test_tokens_are_laid_out_as_one_text(spark, tmp_path, monkeypatch):
    """What an append shuffles and writes in between holds no array of tokens; documents without tokens stay."""
    seen, write = [], blockindex.materialise
    monkeypatch.setattr(blockindex, "materialise", lambda df, tag: (seen.append(df.schema), write(df, tag))[1])
    held = blockindex.BlockIndex(spark, f"file://{tmp_path}/b")
    assert held.append(spark.createDataFrame([(1, "One two one"), (2, ""), (3, None), (4, "two 文字列")], "doc_id long, text string")) == 4
    assert not [f.name for schema in seen for f in schema.fields if f.dataType.simpleString() == "array<string>" and f.name != "entities"]
    assert sorted((r.token, [e.tf for e in r.entries]) for r in held._table("postings").collect()) == [("one", [2]), ("two", [1, 1]), ("字列", [1]), ("文字", [1])]
    assert held.holds().count() == 4
