"""Import loops: against a loop one item at a time, and through the engine."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.engine import KnowledgeEngine
from marginalia.operators import importloop
from marginalia.sources import captions

ITEMS = "position long, guid string, title string, url string, transcript_url string, incomplete string"
READ = "guid string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>, error string"


def one_by_one(items, state, known, read, limit, count_skips):
    titles, urls = {k[1] for k in known if k[1]}, {k[2] for k in known if k[2]}
    out, counted = {}, 0
    for position, guid, title, url, transcript, incomplete in sorted(items):
        if limit is not None and counted >= limit:
            out[guid] = "not_reached"
        elif state.get(guid) in importloop.TERMINAL:
            out[guid] = "already_done"
        elif incomplete:
            out[guid] = "skipped_incomplete"
        elif not transcript:
            out[guid] = "missing_transcript"
        elif title in titles or (url and url in urls):
            out[guid] = "skipped_existing"
        elif not read.get(guid):
            out[guid] = "error"
        else:
            out[guid] = "imported"
            titles.add(title)
            urls.add(url or None)
        counted += out[guid] == "imported" or (count_skips and out[guid] == "skipped_existing")
    return out


@pytest.mark.parametrize("seed, limit, count_skips", [(1, None, True), (2, 12, True), (3, 12, False), (4, 0, True)])
def test_against_one_item_at_a_time(spark, seed, limit, count_skips):
    rng = random.Random(seed)
    items = [(i // 2, f"g{i}", f"T{rng.randrange(25)}", rng.choice([None, "", f"u{rng.randrange(25)}"]), rng.choice(["t", "t", "t", None]), "odd" if rng.random() < 0.1 else None) for i in range(60)]
    state = {f"g{i}": rng.choice(["imported", "error"]) for i in range(0, 60, 7)}
    known = [("s1", "T3", "u4"), ("s2", "T9", None)]
    read = {f"g{i}": [] if rng.random() < 0.2 else [(0, 900, "Some words of it."), (900, 1000, "And more.")] for i in range(60) if rng.random() < 0.9}
    loop = importloop.import_loop(
        spark.createDataFrame(items, ITEMS), spark.createDataFrame(list(state.items()), "guid string, status string"), spark.createDataFrame(known, "source_id string, title string, url string"),
        spark.createDataFrame([(g, s, None) for g, s in read.items()], READ), "Show", limit=limit, count_skips=count_skips,
    )
    rows = loop.results.collect()
    want = one_by_one(items, state, known, read, limit, count_skips)
    assert {r.guid: r.status for r in rows} == want and len(rows) == 60
    new = {r.source_id for r in rows if r.status == "imported"}
    assert {r.source_id for r in loop.made["sources"].collect()} == new and loop.made["chunks"].count() == 2 * len(new)
    assert all(r.source_id in new | {"s1", "s2"} for r in rows if r.status == "skipped_existing") and all((r.reason is not None) == (r.status in ("error", "skipped_incomplete")) for r in rows)


def test_chains_of_shared_keys(spark):
    # each shares its title with the one before and its address with the one after: every second one stays
    rows = [(i, f"T{(i + 1) // 2}", f"u{i // 2}") for i in range(12)]
    kept = importloop.first_come(spark.createDataFrame(rows, "at int, title string, url string"), "at", ["title", "url"])
    assert sorted(r["at"] for r in kept.collect()) == list(range(0, 12, 2))
    assert importloop.first_come(spark.createDataFrame([], "at int, title string"), "at", ["title"]).count() == 0


def test_no_items(spark):
    empty = importloop.import_loop(
        spark.createDataFrame([], ITEMS), spark.createDataFrame([], "guid string, status string"), spark.createDataFrame([], "source_id string, title string, url string"), spark.createDataFrame([], READ), "S", limit=3
    )
    assert empty.results.count() == 0 and empty.made["sources"].count() == 0


def test_engine_imports_goes_on_after_errors_and_takes_up_again(spark, tmp_path):
    engine = KnowledgeEngine(spark, f"file://{tmp_path}/corpus")
    engine.add_text_source("Elsewhere", "Nothing of rivers.")
    items = spark.createDataFrame([(i, f"g{i}", f"Part {i}", f"https://e.org/{i}", "t", i) for i in range(1, 6)], "position long, guid string, title string, url string, transcript_url string, number int")
    vtt = "WEBVTT\n\n00:00.000 --> 00:02.000\nThe river number {} is long.\n"
    texts = [("g1", vtt.format(1), "t.vtt"), ("g2", None, "t.vtt"), ("g3", "<p>A page about the otter and the river, long enough.</p>", "t.html"), ("g4", "WEBVTT\n", "t.vtt"), ("g5", vtt.format(5), "t.vtt")]
    kind = "guid string, content string, url string"
    contents = spark.createDataFrame(texts, kind).withColumn("mime", F.lit(None).cast("string")).withColumn("seconds", F.lit(10))
    done = {r.guid: r for r in engine.import_transcripts(items, contents, "Show", numbers=(None, 4)).collect()}
    assert {g: r.status for g, r in done.items()} == {"g1": "imported", "g2": "error", "g3": "imported", "g4": "error"}
    assert done["g2"].reason == importloop.UNREAD and done["g4"].reason == importloop.SILENT
    mended = contents.withColumn("content", F.coalesce("content", F.lit(vtt.format(2))))
    again = {r.guid: r.status for r in engine.import_transcripts(items, mended, "Show", limit=1).collect()}
    assert again == {"g1": "already_done", "g2": "imported", "g3": "not_reached", "g4": "not_reached", "g5": "not_reached"}
    rest = {r.guid: r.status for r in engine.import_transcripts(items, mended, "Show").collect()}
    assert rest == {"g1": "already_done", "g2": "already_done", "g3": "already_done", "g4": "error", "g5": "imported"}
    titles = {r.title: (r.preference, r.weight) for r in engine.list_sources().collect()}
    assert titles.pop("Elsewhere") and set(titles) == {f"Show: Part {i} (Published Transcript)" for i in (1, 2, 3, 5)} and set(titles.values()) == {("published", 1.0)}
    assert {r.title for r in engine.search_knowledge("otter river", 1, "keyword", language_policy="any").collect()} == {"Show: Part 3 (Published Transcript)"}
    assert engine.import_transcripts(items, mended, "Show", kind="Generated").where("status = 'imported'").count() == 0  # the addresses are there


def test_transcripts_are_read_in_their_own_rows(spark):
    block = "{}\n00:0{}.000 --> 00:0{}.500 align:start\n{}\n\n"
    said = ["<v A>one</v>\n two", "a &amp; b &#x41;&lt;&nopenope; &amp c", "\t x  y\u00a0 ", "<![CDATA[in <b>side</b>]]> &nbsp;", " ", "end \u2028", "R&D", "5 --> 6\nz"]
    vtt = "WEBVTT\n\nNOTE 3 --> x\n\n" + "".join(block.format(i, i, i, s) for i, s in enumerate(said)) + "bad 0:0:0:0 --> 1:2:3:4\nno time\n\nplain block\r\n\r\n00:09.000 --> 00:10.000\r\nlast\r\n"
    texts = [("a", vtt, "t.vtt"), ("b", None, "t.vtt"), ("c", "WEBVTT\n", "t.vtt"), ("d", "<p>A page &amp; a paragraph.</p><p>Another one of it.</p>", "t.html"), ("e", "", "t.vtt"), (None, vtt, "t.vtt")]
    contents = spark.createDataFrame(texts, "guid string, content string, url string").withColumn("mime", F.lit(None).cast("string")).withColumn("seconds", F.lit(60))
    read = importloop.read_transcripts(contents)
    got = {r.guid: ([tuple(s) for s in r.segments or []], r.error) for r in read.collect()}
    want = captions.vtt(contents.where("guid = 'a'").select(F.col("guid").alias("file"), "content")).orderBy("idx").collect()
    assert got["a"] == ([(r.start_ms, r.end_ms, r.body) for r in want], None) and len(want) > 7
    assert got["b"] == ([], importloop.UNREAD) and got["c"] == got["e"] == ([], importloop.SILENT)
    assert [s[2] for s in got["d"][0]] == ["A page & a paragraph. Another one of it."] and got[None] == got["a"]
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()


def test_one_text_counts_where_a_guid_has_two(spark):
    items = spark.createDataFrame([(1, "g", "T", "u", "t", None)], ITEMS)
    read = spark.createDataFrame([("g", None, "odd"), ("g", [(0, 5, "One."), (5, 9, "Two.")], None), ("g", [(0, 9, "Only.")], None), (None, [(0, 9, "No one's.")], None)], READ)
    loop = importloop.import_loop(items, spark.createDataFrame([], "guid string, status string"), spark.createDataFrame([], "source_id string, title string, url string"), read, "S")
    row = loop.results.first()
    assert row.status == "imported" and loop.made["chunks"].count() == row.n_segments and loop.made["sources"].count() == 1
