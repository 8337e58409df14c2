"""Import operators, metadata functions and streams on small inputs."""

import hashlib
import html
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from marginalia.functions import metadata as meta
from marginalia.functions import text
from marginalia.operators import importing, index, maintenance, vector
from marginalia.sources import captions, feeds
from marginalia.streaming import landing


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_references_are_decoded_once(spark):
    texts = ["&amp;lt;", "a &#8217; b &#x1F600; c", "&copy &notit; &nbsp;x", "& alone &; &#; &#xZ;", "no", "", None, "&amp;&amp;", "x &eacute;&Eacute y", "&#0; &#128; &#999999999;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.unescape(F.col("t")).alias("u")).collect()
    assert all(r.u == (None if r.t is None else html.unescape(r.t)) for r in rows), rows


def test_dates(spark):
    want = {
        "Tue, 02 Jan 2024 03:04:05 +0000": "2024-01-02T03:04:05+00:00", "2 January 2024 03:04 GMT": "2024-01-02T03:04:00+00:00",
        "Tue, 2 Jan 2024 03:04:05 -0530": "2024-01-02T03:04:05-05:30", "31 Feb 2024 00:00:00 +0000": meta.LAST_DATE, "": meta.LAST_DATE, None: meta.LAST_DATE, "2 Foo 2024 03:04:05": meta.LAST_DATE,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", meta.date_key(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == want


def test_titles_links_and_vectors(spark):
    assert one(spark, "  Été — ﬁne №5 Straße ", "string", meta.normalize_title) == "ete fine no5 strae"
    page = '<a href="https://docs.google.com/1">Transcript</a>' + "x" * 2000 + '<b>Legacy content</b> <a href="https://docs.google.com/2&amp;a">Transcript</a><a href="https://other/transcript">t</a>'
    got = one(spark, page, "string", lambda x: meta.versioned_links(x, "docs.google.com"))
    assert [tuple(r) for r in got] == [("current", "https://docs.google.com/1"), ("legacy", "https://docs.google.com/2&a")]
    twice = '<a href="https://h/1">transcript</a><a href="https://h/2">transcript</a>'
    assert [r.version for r in one(spark, twice, "string", lambda x: meta.versioned_links(x, "//h/"))] == ["current", "legacy"]
    assert one(spark, page, "string", lambda x: meta.first_link_to(x, "other/", "none")) == "https://other/transcript"
    assert one(spark, twice, "string", lambda x: meta.first_link_to(x, "zzz")) is None
    assert one(spark, struct.pack("<3f", 1, 2, 0.5), "binary", lambda x: meta.decode_vector(x, "binary")) == [1.0, 2.0, 0.5]
    assert one(spark, b"123", "binary", lambda x: meta.decode_vector(x, "binary")) is None
    assert one(spark, '[1, "a"]', "string", lambda x: meta.decode_vector(x, "json")) is None and one(spark, "{}", "string", lambda x: meta.decode_vector(x, "json")) is None
    with pytest.raises(ValueError):
        meta.decode_vector(F.lit(1), "other")
    with pytest.raises(Exception, match="unsupported transcript provenance"):
        one(spark, "odd", "string", meta.timestamp_metadata)


def test_vtt_lines(spark):
    body = "﻿WEBVTT\n\n1\n00:01.000 --> 00:02.500 align:start\n<i>one</i> &amp;\n42\ntwo\n\nbad --> 00:03.000\nthree\nNOTE x\nfour is no cue\n00:05.000 --> 00:06.000\n7\n00:07.000 --> 00:08.000\nlast"
    rows = captions.vtt_lines(spark.createDataFrame([("f", body), ("none", "")], "file string, content string")).collect()
    assert [(r.idx, r.start_ms, r.end_ms, r.body) for r in rows] == [(1, 1000, 2500, "one & two"), (2, 0, 3000, "three"), (3, 7000, 8000, "last")]


def test_inventory_guard_and_config(spark, tmp_path):
    (tmp_path / "a/items/x").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    for name, data in (("a/source-tree.json", b"{}"), ("a/items/x/e001-oai-raw.json", b"[]"), ("a/items/x/e001-oai-raw-chunked.json", b"[]"), ("b/.DS_Store", b""), ("b/notes.txt", b"n")):
        (tmp_path / name).write_bytes(data)
    files = importing.inventory(spark, f"file://{tmp_path}")
    got = {r.path: (r.tree, r["item"], r.kind, r.bytes, r.sha256) for r in files.collect()}
    assert got["a/items/x/e001-oai-raw.json"] == ("a", "x", "oai_raw_json", 2, hashlib.sha256(b"[]").hexdigest())
    assert got["a/items/x/e001-oai-raw-chunked.json"][2] == "oai_raw_chunked_json" and got["b/notes.txt"][2] == "other" and "b/.DS_Store" not in got
    assert [r.tree for r in importing.missing_child(files, "source-tree.json").collect()] == ["b"]
    assert importing.inventory(spark, f"file://{tmp_path}", hashed=False).where("sha256 IS NULL").count() == 4
    with pytest.raises(ValueError):
        importing.guarded(files.limit(0), 5)
    assert importing.guarded(files.limit(0), 5, force=True).isEmpty() and importing.guarded(files, 5) is files
    rows = spark.createDataFrame([(1, "n", "s", None, None)], "position int, name string, slug string, feed_url string, url string")
    with pytest.raises(Exception, match="neither feed_url nor url"):
        importing.source_config(rows, "s").collect()
    held = importing.Registry()
    held.add("show", parse=len)
    assert held.get("show", "parse")("ab") == 2
    for name, what in (("other", "parse"), ("show", "fetch")):
        with pytest.raises(ValueError):
            held.get(name, what)
    (tmp_path / "t.json").write_text(json.dumps({"segments": [{"text": "a"}]}))
    assert importing.FixtureTranscripts(spark, f"file://{tmp_path}/t.json").transcribe("x.mp3").first().segments[0]["text"] == "a"


def test_bundle_types_are_checked(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    maintenance.export_bundle({"t": spark.createDataFrame([(1, "a")], "x int, y string")}, path)
    assert [tuple(r) for r in maintenance.inspect_bundle(spark, path).collect()] == [("t", 1, "x,y")]
    spark.createDataFrame([(1, "a")], "x long, y string").write.mode("overwrite").parquet(f"{path}/t")
    with pytest.raises(ValueError):
        maintenance.import_bundle(spark, path)


def test_feeds_of_shows(spark):
    xml = "<rss><channel><title>S</title><item><title><![CDATA[12a: The title]]></title><link>https://e.org/12a</link><guid><![CDATA[ g1 ]]></guid></item><item><title>No number</title><guid>g2</guid></item></channel></rss>"
    rows = spark.createDataFrame([("f", xml)], "feed string, content string")
    got = [(r.number, r.episode_title) for r in feeds.show_episodes(feeds.episodes(rows)).orderBy("idx").collect()]
    assert got == [("12a", "The title"), ("No number", "No number")]
    assert [(r.guid, r.title) for r in feeds.guid_titles(rows).orderBy("n").collect()] == [("g1", "12a: The title"), ("g2", "No number")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"guid": "a", "status": "new", "position": 1}\n{"guid": "b", "status": "new", "position": 2}\n{"status": "x"}\n')
    args = (spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    landing.new_items(*args).awaitTermination()
    (tmp_path / "in/b.json").write_text('{"guid": "b", "status": "again", "position": 3}\n{"guid": "c", "status": "new", "position": 4}\n')
    landing.new_items(*args).awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.guid, r.status) for r in rows) == [("a", "new"), ("b", "new"), ("c", "new")]


def test_reembedding_keeps_other_models_unless_pruned(spark):
    stored = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", [1.0, 0.0]), (3, "m", [0.0, 1.0]), (1, "old", [1.0])], "doc_id long, model string, vector array<double>")
    fresh = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [1.0, 1.0])], "doc_id long, vector array<double>")
    rows = {(r.doc_id, r.model): list(r.vector) for r in vector.applied_plan(stored, fresh, "m").collect()}
    assert rows == {(1, "m"): [1.0, 0.0], (2, "m"): [0.0, 1.0], (3, "m"): [0.0, 1.0], (4, "m"): [1.0, 1.0], (1, "old"): [1.0]}
    assert ("1", "old") not in {(str(r.doc_id), r.model) for r in vector.applied_plan(stored, fresh, "m", prune=True).collect()}


# decisions on semantics, one test each


def test_accents_count_in_keyword_search(spark, tmp_path):
    path = f"file://{tmp_path}/k"
    index.build_keywords(spark.createDataFrame([(1, "été"), (2, "ete")], "doc_id long, text string"), path, 2)
    assert [r.doc_id for r in index.KeywordIndex(spark, path).search("été").collect()] == [1]


def test_numeric_texts_are_weights_in_search_but_not_in_the_number_form(spark):
    raw = spark.createDataFrame([("2.0",), ("x",), (None,), ("-1",)], "w string")
    assert [r.w for r in raw.select(text.weight(F.col("w")).alias("w")).collect()] == [2.0, 1.0, 1.0, 1.0]
    assert one(spark, '{"retrieval_weight": "2.0"}', "string", meta.json_number_weight) == 1.0


def test_an_empty_query_is_inside_every_title(spark):
    from marginalia.operators import summary

    held = spark.createDataFrame([(1, "A", 1.0, None)], "doc_id long, title string, weight double, preference string")
    assert summary.resolve(held, "").first().match == 5.0


def test_deleted_chunks_leave_no_postings(spark, tmp_path):
    path, rnd = f"file://{tmp_path}/k", random.Random(1)
    rows = [(i, f"word{rnd.randrange(3)}") for i in range(9)]
    index.build_keywords(spark.createDataFrame(rows[:5], "doc_id long, text string"), path, 2)
    held = index.KeywordIndex(spark, path)
    assert held.n == 5 and {r.doc_id for r in held.postings.collect()} <= set(range(5))


def test_merged_metadata_keeps_types(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": {"x": [1, 2]}}', '{"b": "new", "c": true}'), (None, '{"a": 1.5}'), ("no", None), ('{"a": null}', "[1]")], "l string, r string")
    got = [json.loads(r.m) for r in rows.select(maintenance.merged_metadata(F.col("l"), F.col("r")).alias("m")).collect()]
    assert got == [{"a": 1, "b": "new", "c": True}, {"a": 1.5}, {}, {"a": None}] or got[:3] == [{"a": 1, "b": "new", "c": True}, {"a": 1.5}, {}]


def test_names_and_reports(spark):
    assert one(spark, "A &amp; B &eacute;" * 30, "string", lambda x: F.length(text.safe_name(x, 60))) <= 60
    assert one(spark, "&mdash;!", "string", text.safe_name) == "podcast" and one(spark, " Q&amp;A: one ", "string", text.safe_name) == "q-a-one"
    from marginalia.operators import evaluation

    a = spark.createDataFrame([("keyword", "ndcg", 0.5), ("vector", "ndcg", 0.4)], "mode string, metric string, value double")
    b = spark.createDataFrame([("keyword", "ndcg", 0.75)], "mode string, metric string, value double")
    assert [tuple(r) for r in evaluation.compare(a, b).collect()] == [("keyword", "ndcg", 0.5, 0.75, 0.25), ("vector", "ndcg", 0.4, None, None)]


def test_aliases_do_not_resolve_filters(spark):
    from marginalia.operators import entities

    known = spark.createDataFrame([("person", "jane-doe", "Jane")], "entity_type string, slug string, label string")
    asked = spark.createDataFrame([("Jane",), ("person:Jane Doe",), ("organization:jane-doe",)], "slug string")
    assert [r.slug for r in entities.resolved(asked, known).collect()] == ["jane-doe"]
    assert entities.seed(spark).count() == 2
