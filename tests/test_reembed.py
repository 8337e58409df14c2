"""Re-embedding by ranges: stopped, failed and taken up again."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators.reembed import Reembedding


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame([(i, f"s{i % 3}", float(i)) for i in range(100)], "doc_id long, source_id string, x double")
    old = [(i, "m", [float(i), 1.0]) for i in range(0, 90, 2)] + [(i, "m", [-float(i), 1.0]) for i in range(1, 60, 2)]
    old += [(4, "m", [4.0, 1.0]), (500, "m", [1.0, 1.0]), (3, "other", [1.0]), (7, None, [1.0])]
    return chunks, spark.createDataFrame(old, "doc_id long, model string, vector array<double>")


def embed(rows):
    return rows.select("doc_id", F.array("x", F.lit(1.0)).alias("vector"))


def rows_of(frame):
    return sorted((r.doc_id, r.model or "", list(r.vector)) for r in frame.collect())


def test_a_stopped_run_ends_as_one_that_was_not(spark, tables, tmp_path):
    chunks, stored = tables
    one = Reembedding(spark, f"file://{tmp_path}/one", chunks, stored, "m", embed, size=1000)
    assert one.run() == 1
    several = Reembedding(spark, f"file://{tmp_path}/two", chunks, stored, "m", embed, size=17)
    planned = several.plan().count()
    assert planned > 4 and several.run(2) == 2 and several.left().count() == planned - 2
    half = several.result()
    assert half.where("model = 'm'").count() >= 75

    def broken(rows):
        return embed(rows).withColumn("vector", F.when(F.col("doc_id") > 60, F.raise_error(F.lit("no vector"))).otherwise(F.col("vector")))

    with pytest.raises(Exception, match="no vector"):
        Reembedding(spark, f"file://{tmp_path}/two", chunks, stored, "m", broken, size=17).run()
    again = Reembedding(spark, f"file://{tmp_path}/two", chunks, stored, "m", embed, size=5)
    assert 0 < again.left().count() < planned - 2
    again.run()
    assert again.run() == 0 and rows_of(again.result()) == rows_of(one.result())
    counts = {r.action: r.n for r in again.counts().collect()}
    assert counts == {r.action: r.n for r in one.counts().collect()}
    # 4 is stored twice, 500 has no chunk any more, 1.. were turned round, 91.. are new
    assert counts == {"unchanged": 44, "updated": 31, "created": 25, "orphaned": 1, "other_models": 2}
    assert {r.model for r in again.result(prune=True).select("model").distinct().collect()} == {"m"}
    assert len(rows_of(again.result(prune=True))) == 101


def test_one_source_and_nothing_to_do(spark, tables, tmp_path):
    chunks, stored = tables
    part = Reembedding(spark, f"file://{tmp_path}/part", chunks, stored, "m", embed, size=10, source="s1")
    part.run()
    assert sum(r.n for r in part.counts().collect() if r.action != "other_models") == 33
    assert {r.doc_id % 3 for r in part.result().collect()} == {1}
    empty = Reembedding(spark, f"file://{tmp_path}/empty", chunks.limit(0), stored.limit(0), "m", embed)
    assert empty.run() == 0 and empty.result().collect() == [] and empty.counts().collect() == []
