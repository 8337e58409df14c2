"""Bundles by content: one byte, one file more or less, limits, and a corpus through a bundle."""

import os

import pytest

from marginalia.engine import KnowledgeEngine
from marginalia.operators import maintenance
from marginalia.operators.maintenance import BundleLimits, BundleRefused


@pytest.fixture
def bundle(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "concat('row ', id) AS text").repartition(3)
    maintenance.export_bundle({"rows": rows, "none": rows.limit(0)}, f"file://{tmp_path}/b", {"model": "m"})
    return tmp_path / "b"


def parts(folder):
    return sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))


def touch(folder, name, content):
    """Write a file and take its checksum's neighbour away, as one from elsewhere has none."""
    (folder / name).write_bytes(content)
    side = folder / f".{name}.crc"
    if side.exists():
        side.unlink()


def test_whole(spark, bundle):
    back = maintenance.import_bundle(spark, f"file://{bundle}")
    assert back["rows"].count() == 1000 and back["none"].count() == 0 and back["none"].columns == ["id", "text"]
    assert maintenance.bundle_problems(spark, f"file://{bundle}").count() == 0


def test_one_flipped_byte(spark, bundle):
    name = parts(bundle / "rows")[1]
    content = bytearray((bundle / "rows" / name).read_bytes())
    content[len(content) // 3] ^= 1
    touch(bundle / "rows", name, bytes(content))
    with pytest.raises(BundleRefused, match=f"rows/{name}: other content"):
        maintenance.import_bundle(spark, f"file://{bundle}")


def test_files_more_or_less_with_counts_that_agree(spark, bundle):
    first, second = parts(bundle / "rows")[:2]
    os.rename(bundle / "rows" / first, bundle / "rows" / "part-x.parquet")
    touch(bundle / "rows", second, (bundle / "rows" / second).read_bytes()[:-1])
    found = {r.name: r.problem for r in maintenance.bundle_problems(spark, f"file://{bundle}").collect()}
    assert found == {f"rows/{first}": "missing", "rows/part-x.parquet": "added", f"rows/{second}": "other size"}


def test_a_listing_made_to_fit_is_refused(spark, bundle):
    listing = spark.read.parquet(f"file://{bundle}/files").selectExpr("name", "bytes", "reverse(sha256) AS sha256").collect()
    spark.createDataFrame(listing, maintenance._LISTING).write.mode("overwrite").parquet(f"file://{bundle}/files")
    with pytest.raises(BundleRefused, match="listing"):
        maintenance.import_bundle(spark, f"file://{bundle}")


@pytest.mark.parametrize("limits", [BundleLimits(file_bytes=100), BundleLimits(total_bytes=1000), BundleLimits(files=2), BundleLimits(files=0), BundleLimits(file_bytes=1 << 31), BundleLimits(files=2.5)])
def test_limits(spark, bundle, limits):
    with pytest.raises(BundleRefused):
        maintenance.import_bundle(spark, f"file://{bundle}", limits)


@pytest.mark.parametrize("name", ["../up", "a/b", "files", "manifest", "_t", ""])
def test_names(spark, tmp_path, name):
    with pytest.raises(BundleRefused):
        maintenance.export_bundle({name: spark.range(1)}, f"file://{tmp_path}/n")


def test_a_corpus_through_a_bundle(spark, tmp_path):
    engine = KnowledgeEngine(spark, f"file://{tmp_path}/one")
    engine.add_text_source("Otters", "The otter swims in the river.")
    engine.export(f"file://{tmp_path}/bundle")
    other = KnowledgeEngine(spark, f"file://{tmp_path}/two")
    counts = other.restore(f"file://{tmp_path}/bundle")
    assert counts["sources"] == counts["chunks"] == 1
    assert [r.title for r in other.search_knowledge("otter", 3, "keyword", language_policy="any").collect()] == ["Otters"]
    with pytest.raises(ValueError, match="empty"):
        other.restore(f"file://{tmp_path}/bundle")
