"""Folders as a data source: the same rows as the functions over whole texts, malformed files as rows."""

import json
import random

import pytest

from marginalia.sources import captions, feeds, readers


def put(folder, files):
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())


def texts(spark, files, key="file"):
    return spark.createDataFrame([(n, c) for n, c in files.items()], f"{key} string, content string")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert a.count() > 0


def test_captions(spark, tmp_path):
    rng = random.Random(1)
    end = ["\n", "\r\n"]
    files = {}
    for k in range(6):
        nl = end[k % 2]
        cues = [f"{i}{nl}00:{i:02}.5 --> 00:{i + 1:02},250{nl}" + nl.join(rng.choice(["<b>fish</b> &amp; chips", "a line", "  ", "näh da"]) for _ in range(rng.randrange(1, 4))) for i in range(9)]
        files[f"d{k % 2}/f{k}.vtt"] = f"WEBVTT{nl}{nl}" + (nl * 2).join(cues) + nl * rng.randrange(3)
    put(tmp_path, files | {"bad/none.vtt": "WEBVTT\n\nno times here\n", "bad/bytes.vtt": b"WEBVTT\n\n00:00.0 --> 00:01.0\nok\n\n00:01.0 --> 00:02.0\n\xff\xfe\n", "bad/empty.vtt": "", "other.txt": "x"})
    found = readers.units(spark, f"file://{tmp_path}", "vtt", 400)
    assert found.rdd.getNumPartitions() > 1
    good = found.where("file NOT LIKE 'bad/%'")
    same(captions.vtt(texts(spark, files)), readers.vtt_cues(good))
    assert {r.file: r.error for r in readers.errors(found).collect()} == {"bad/none.vtt": "no timing line", "bad/bytes.vtt": "no UTF-8", "bad/empty.vtt": "no timing line"}
    one = found.where("file = 'd0/f0.vtt'")
    assert {r.file for r in one.collect()} == {"d0/f0.vtt"} and one.rdd.getNumPartitions() == 1


def test_feeds_across_reads(spark, tmp_path, monkeypatch):
    item = '<item><title>T{0} &amp; more</title><guid isPermaLink="false">g{0}</guid><link>https://e.org/{0}</link><itunes:duration>1:0{0}</itunes:duration><podcast:transcript url="u{0}" type="text/vtt"/></item>'
    head = "<?xml version='1.0'?><rss><channel><title>Feed</title><itemless/>"
    files = {f"f{k}.xml": head + "".join(item.format(i) for i in range(k + 1)) + "</channel></rss>" for k in range(4)}
    put(tmp_path, files | {"x.xml": "<rss></rss>", "cut.rss": head + item.format(7) + "<item><title>half"})
    found = readers.units(spark, f"file://{tmp_path}", "rss")
    same(feeds.episodes(texts(spark, files, "feed")), readers.feed_items(found.where("file LIKE 'f%'")))
    assert {r.file: r.error for r in readers.errors(found).collect()} == {"x.xml": "no channel in the feed", "cut.rss": "an item without an end"}
    assert readers.feed_items(found.where("file = 'cut.rss'")).first().title == "T7 & more"
    import io

    monkeypatch.setattr(readers, "_READ", 7)  # tags lie across reads
    for content in files.values():
        assert list(readers._items(io.StringIO(content))) == readers._ITEM.findall(content)


def test_json(spark, tmp_path):
    cues = {f"c{k}.json3": json.dumps({"events": [{"tStartMs": 100 * i, "dDurationMs": 250, "segs": [{"utf8": f"word {i}", "tOffsetMs": 5}]} for i in range(k + 1)]}) for k in range(3)}
    chunks = {f"r{k}.json": json.dumps([{"text": f"part {i}", "metadata": {"start": f"{i}30"}} for i in range(k + 1)]) for k in range(3)}
    put(tmp_path, cues | chunks | {"bad.json": "{"})
    found = readers.units(spark, f"file://{tmp_path}", "json")
    same(captions.json_captions(texts(spark, cues)), readers.json_cues(found.where("file LIKE 'c%'")))
    same(captions.recogniser_chunks(texts(spark, chunks)), readers.recogniser_cues(found.where("file LIKE 'r%'")))
    assert [tuple(r) for r in readers.errors(found).collect()] == [("bad.json", "no JSON")]


def test_limits_and_empty_folders(spark, tmp_path, monkeypatch):
    import io

    monkeypatch.setattr(readers, "UNIT", 20)
    with pytest.raises(readers.Malformed):
        list(readers._blocks(io.StringIO("a line of text\nanother line of text\n")))
    with pytest.raises(readers.Malformed):
        list(readers._whole(io.StringIO('"' + "x" * 30 + '"')))
    assert readers.units(spark, f"file://{tmp_path}", "vtt").count() == 0
    with pytest.raises(Exception, match="kind"):
        readers.units(spark, f"file://{tmp_path}", "pdf").count()
