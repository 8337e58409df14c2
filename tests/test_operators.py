"""Operators on small literal inputs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions.language import detect
from marginalia.operators import entities, filters, fusion, ingest, keyword, maintenance, planning, retrieval, segmentation, summary, vector
from marginalia.sources import captions, feeds
from marginalia.store import Store
from marginalia.streaming import landing


def chunks(spark, rows):
    return spark.createDataFrame([(i, t, w, f"T{i}") for i, (t, w) in enumerate(rows)], "doc_id long, text string, weight double, title string")


def test_bm25_ranks_the_target_over_fillers(spark):
    rows = [("what does the book say about the thing and the other thing", 1.0)] * 12 + [("what does the book say about the exodus", 1.0)]
    best = keyword.search(chunks(spark, rows), "what does the book say about the exodus", 3).collect()
    assert best[0].doc_id == 12
    assert keyword.search(chunks(spark, rows), "?!").count() == 0
    weighted = [("exodus here", 1.0), ("exodus here", 5.0)]
    assert keyword.search(chunks(spark, weighted), "exodus AND here", 2).first().doc_id == 1


def test_operators_are_words_and_scopes_differ(spark):
    rows = [("near and not", 1.0), ("fruit", 1.0), ("fruit near", 1.0)]
    assert {r.doc_id for r in keyword.search(chunks(spark, rows), "near OR").collect()} == {0, 2}
    few = chunks(spark, rows).where("doc_id > 0")
    local = keyword.search(few, "fruit").first().score
    wide = keyword.search(few, "fruit", corpus=chunks(spark, rows)).first().score
    assert local != wide


def test_index_and_scan_agree(spark):
    rows = chunks(spark, [("a b c", 1.0), ("a a d", 1.0), ("b d e f", 1.0)])
    asked = spark.createDataFrame([(1, "a d"), (2, "f")], "query_id long, text string")
    many = keyword.search_many(rows, asked, 1).orderBy("query_id").collect()
    assert [(r.query_id, r.doc_id) for r in many] == [(1, 1), (2, 2)]
    scan = keyword.search(rows.drop("weight"), "a d").first()
    assert scan.doc_id == 1 and scan.score == pytest.approx(many[0].score)


def test_vector_guards(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "m", 1), (2, [0.0, 1.0], "m", 1), (3, [1.0, 0.0, 0.0], "m", 1), (1, [0.0, 1.0], "m", 2), (4, None, "m", 1), (5, [1.0, 0.0], "other", 1)], "doc_id long, vector array<double>, model string, created_at int")
    held = vector.one_model(rows, 2, "m")
    assert {r.doc_id for r in vector.search(held, [0.0, 2.0]).collect()} == {1, 2}
    assert vector.search(held, [0.0, 0.0]).count() == 0
    plan = vector.compare_stored(spark.createDataFrame([(1, [1.0]), (2, [1.0]), (2, [1.0]), (3, [1.0])], "doc_id long, vector array<double>"), spark.createDataFrame([(1, [2.0]), (2, [1.0]), (4, [1.0])], "doc_id long, vector array<double>"))
    assert {r.doc_id: r.action for r in plan.collect()} == {1: "unchanged", 2: "updated", 3: "orphaned", 4: "created"}


def test_fusion_needs_both_runs(spark):
    run = lambda *x: spark.createDataFrame([(d, s) for d, s in x], "doc_id long, score double")
    got = fusion.fuse([run((1, 99.0), (2, 5.0)), run((2, 0.9), (3, 0.8))], 2).collect()
    assert got[0].doc_id == 2 and got[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_filters(spark):
    rows = spark.createDataFrame([(1, "en", "a"), (2, None, "a"), (3, "de", "b")], "doc_id long, language string, tree string")
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(rows.transform(filters.language("en"))) == {1}
    assert ids(rows.transform(filters.language("en", True))) == {1, 2}
    assert ids(rows.transform(filters.language(None)).transform(filters.tree("b"))) == {3}
    links = spark.createDataFrame([(1, "x"), (3, "y")], "doc_id long, slug string")
    assert ids(rows.transform(filters.entities(links, ["x", "zz"], ["x", "y"]))) == {1}
    assert ids(rows.transform(filters.entities(links, ["zz"], ["x", "y"]))) == set()
    assert ids(rows.transform(filters.entities(links, []))) == {1, 2, 3}


def test_language_policy():
    counts = {"en": 12, "es": 1, None: 2}
    d = retrieval.Decision
    assert retrieval.decide(counts, "any", "es", ("es", 0.9)) == d(None, False)
    assert retrieval.decide(counts, "auto", None, ("es", 0.9)) == d("en", True)
    assert retrieval.decide(counts, "auto", "es", ("en", 0.9)) == d("es", True)
    assert retrieval.decide(counts, "strict", None, ("es", 0.9)) == d("es", False)
    assert retrieval.decide(counts, "strict", "xx", ("en", 0.9)) == d("en", False)
    assert retrieval.decide({}, "auto", None, (None, 0.0)) == d(None, True)
    with pytest.raises(ValueError):
        retrieval.decide(counts, "maybe", None, (None, 0.0))
    assert retrieval.notice(counts, 0, (None, 0.0))["corpus_languages"] == ["en", "es"]
    assert retrieval.notice(counts, 3, ("ru", 0.9))["query_language"] == "ru"
    assert retrieval.notice(counts, 3, ("en", 0.9)) is None and retrieval.notice({}, 3, ("ru", 0.9)) is None


def test_chunks_keep_offsets(spark):
    body = "first one\n\n \n second\n\n" + "x" * 30
    rows = spark.createDataFrame([(body,), ("  ",), (None,)], "t string").select(segmentation.chunk_text(F.col("t"), 20).alias("c")).collect()
    assert [tuple(c) for c in rows[0].c] == [("first one\n\nsecond", 0, 17), ("x" * 30, 22, 52)]
    assert rows[1].c == [] and rows[2].c is None


def test_cues(spark):
    kind = "array<struct<start_ms:bigint,end_ms:bigint,body:string>>"
    cues = [(0, 1000, "a" * 6), (1000, 2000, "b" * 6), (2000, 9000, "c")]
    row = spark.createDataFrame([(cues,)], f"c {kind}").select(segmentation.pack_cues(F.col("c"), 13, 4000).alias("x")).first()
    assert [tuple(r) for r in row.x] == [(0, 2000, "a" * 6 + " " + "b" * 6), (2000, 9000, "c")]
    row = spark.range(1).select(segmentation.split_cue(F.lit("abcdefghij"), F.lit(0), F.lit(1000), 4).alias("x")).first()
    assert [tuple(r) for r in row.x] == [(0, 333, "abcd"), (333, 666, "efgh"), (666, 1000, "ij")]


def _window(units, begin, target, most):
    """The rules one after another over all possible ends, each measured on the joined text."""
    size = {e: len(" ".join(units[begin:e])) for e in range(begin + 1, len(units) + 1)}
    fit = [e for e in size if size[e] <= most] or [begin + 1]
    closed = [e for e in fit if units[e - 1].rstrip().endswith(segmentation.SENTENCE_ENDS)]
    enough = max(400, int(target * 0.65))
    full = [e for e in closed if size[e] >= max(target, enough)]
    if full:
        return full[0]
    if fit[-1] == len(units):
        return len(units)
    for found in ([e for e in closed if size[e] >= enough][-1:], [e for e in closed if size[e] <= target][-1:], [e for e in fit if size[e] >= target][:1]):
        if found:
            return found[0]
    return fit[-1]


def _back(units, begin, overlap):
    if not begin or overlap <= 0:
        return begin
    fit = [f for f in range(begin) if len(" ".join(units[f:begin])) <= overlap]
    return min([*fit, begin - 1])


def test_grades_of_known_sources(spark):
    from marginalia.operators import evaluation

    run = spark.createDataFrame([("q", i, i) for i in range(1, 5)], "query_id string, doc_id long, rank int")
    judged = spark.createDataFrame([("q", 1, 0), ("q", 2, 1)], "query_id string, doc_id long, grade int")
    known = spark.createDataFrame([("q", 1), ("q", 3), ("q", 3), ("q", 9)], "query_id string, doc_id long")
    assert {r.doc_id: r.grade for r in evaluation.graded(run, judged, known).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}
    every = evaluation.all_grades(judged, known)
    assert {r.doc_id: r.grade for r in every.collect()} == {1: 0, 2: 1, 3: 2, 9: 2}
    row = evaluation.metrics(run, every, 3).first()
    ideal = 3 / math.log2(2) + 3 / math.log2(3) + 1 / math.log2(4)
    assert (row.recall, row.mrr) == (2 / 3, 0.5) and abs(row.ndcg - (1 / math.log2(3) + 3 / math.log2(4)) / ideal) < 1e-12
    alike = evaluation.metrics(run, every, 3, every.select("doc_id", "grade")).first()
    assert (alike.recall, alike.mrr) == (row.recall, row.mrr) and abs(alike.ndcg - row.ndcg) < 1e-12


def test_windows_follow_their_rules():
    rnd = random.Random(1)
    for _ in range(400):
        units = ["x" * rnd.choice([1, 3, 20, 90, 300, 900]) + rnd.choice(["", "", ".", "?'", '!"', ".”", ".’", ","]) for _ in range(rnd.randrange(1, 40))]
        target, most, overlap = rnd.choice([(100, 150, 30), (450, 600, 80), (1800, 2400, 250), (700, 700, 0)])
        held = segmentation.Windows(units, target, most, overlap)
        for begin in range(len(units)):
            assert held.end(begin) == _window(units, begin, target, most)
            assert held.overlap_from(begin) == _back(units, begin, overlap)


def test_streamed_windows_are_those_of_whole_transcripts(monkeypatch):
    rnd, most_held = random.Random(2), 0
    whole = segmentation.Windows

    class Watched(whole):
        def __init__(self, units, *args):
            nonlocal most_held
            most_held = max(most_held, len(units))
            super().__init__(units, *args)

    for _ in range(300):
        units = ["x" * rnd.choice([1, 3, 20, 90, 300, 900]) + rnd.choice(["", "", ".", "?'", ","]) for _ in range(rnd.randrange(0, 60))]
        target, most, overlap = rnd.choice([(100, 150, 30), (450, 600, 80), (1800, 2400, 250), (700, 700, 0), (100, 150, 5000)])
        held, want, begin = whole(units, target, most, overlap), [], 0
        while begin < len(units):
            stop, first = held.end(begin), held.overlap_from(begin)
            want.append((begin, " ".join(units[first:stop]), int(held.place[begin] - held.place[first])))
            begin = stop
        assert list(segmentation.windowed(enumerate(units), target, most, overlap)) == want
    monkeypatch.setattr(segmentation, "Windows", Watched)
    assert len(list(segmentation.windowed(((i, f"sentence number {i} ends here.") for i in range(20_000)), 450, 600, 80))) > 1000
    assert most_held < 40


def test_overlapping_edges(spark):
    kind = "source long, idx long, start_ms long, text string"
    assert segmentation.overlapping(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, 0, 5, "no source."), (1, None, 9, "last of one."), (1, 0, None, "first of one."), (2, 0, 0, None), (3, 1, 1, "same."), (3, 1, 1, "same.")]
    got = segmentation.overlapping(spark.createDataFrame(rows, kind), 450, 600, 40).collect()
    assert {(r.source, r.chunk, r.start_ms, r.body) for r in got} == {(None, 0, 5, "no source."), (1, 0, None, "first of one. last of one."), (3, 0, 1, "same. same.")}


def test_sentence_ends(spark):
    texts = ["a.", "a. ", "a?'", "a!\"", "a.”", "a?”", "a,", "", "a.’", "a.'\u00a0"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(segmentation.ends_sentence(F.col("t")).alias("e")).collect()
    assert [r.e for r in rows] == [True, True, True, True, True, False, False, False, False, True]


def test_overlapping_chunks(spark):
    rows = [(1, i, i * 1000, f"sentence number {i} ends here.") for i in range(60)] + [(2, 0, 0, " ")]
    got = segmentation.overlapping(spark.createDataFrame(rows, "source long, idx long, start_ms long, text string"), 450, 600, 40).orderBy("chunk").collect()
    assert len(got) > 2 and got[0].overlap_chars == 0 and all(r.overlap_chars > 0 for r in got[1:])
    assert all(r.body.endswith(".") and len(r.body) <= 700 for r in got)


def test_summary(spark):
    rows = [(1, "Show 10: old", 0.7, "legacy"), (2, "Show 10: new", 2.0, "current"), (3, "Show 100", 1.0, None)]
    held = spark.createDataFrame(rows, "doc_id long, title string, weight double, preference string")
    assert summary.resolve(held, "show 10").first().doc_id == 2
    assert summary.resolve(held, "show 10", "legacy").first().doc_id == 1
    assert summary.resolve(held, "zzz").count() == 0


def test_entities(spark):
    kind = "doc_id long, type string, slug string, entity_label string, label string, name string, role string"
    raw = spark.createDataFrame([(1, "person", "Jane Doe", "", "Jane", None, None), (1, None, "org:The Place", None, None, "Place", "host"), (2, "topic", "x", "x", "x", "x", None)], kind)
    got = {(r.entity_type, r.slug, r.label, r.role) for r in entities.normalise(raw).collect()}
    assert got == {("person", "jane-doe", "Jane", "related"), ("organization", "the-place", "Place", "host")}
    known = spark.createDataFrame([("jane-doe", "person")], "slug string, entity_type string")
    assert [r.slug for r in entities.upsert(known, entities.normalise(raw)).collect()] == ["the-place"]
    with pytest.raises(Exception, match="two types"):
        entities.upsert(spark.createDataFrame([("jane-doe", "organization")], "slug string, entity_type string"), entities.normalise(raw)).collect()
    links = entities.normalise(raw)
    assert entities.attach(links.where("role = 'host'"), links).count() == 1


def test_queue_and_trees(spark):
    rows = [(1, "a", "t", 5, True), (2, None, "t", 5, True), (3, "b", "t", 5, False), (4, "c", "t", 0, True), (5, "a", "t", 5, True), (6, "d", "t", 9, None)]
    got = planning.queue(spark.createDataFrame(rows, "position long, video_id string, title string, duration int, resolvable boolean")).orderBy("position").collect()
    assert [(r.reason, r.queue_number) for r in got] == [(None, 1), ("missing_video_id_or_title", None), ("video_unavailable", None), ("missing_duration", None), ("duplicate_in_playlist", None), (None, 2)]
    state = spark.createDataFrame([("x", "imported", None)], "item string, status string, error string")
    found = spark.createDataFrame([("x", 1), ("y", 2)], "item string, position long")
    merged = planning.overlay_state(found, state)
    assert {r.item: r.status for r in merged.collect()} == {"x": "imported", "y": "queued"}
    assert planning.resume_point(merged).first().item == "y"


def test_maintenance(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("c", 1), ("e", 1)], "identity string, version int")
    new = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 1)], "identity string, version int")
    assert {r.identity: r.action for r in maintenance.merge_plan(old, new).collect()} == {"a": "replace", "b": "skip", "c": "conflict", "d": "insert", "e": "keep"}
    merged = spark.range(1).select(maintenance.merged_metadata(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}')).alias("m")).first().m
    assert json.loads(merged) == {"a": "1", "b": "3"}
    maintenance.export_bundle({"old": old, "new": new}, f"{tmp_path}/bundle")
    back = maintenance.import_bundle(spark, f"{tmp_path}/bundle")
    assert sorted(map(tuple, back["old"].collect())) == sorted(map(tuple, old.collect()))
    with pytest.raises(Exception):
        maintenance.export_bundle({"old": old}, f"{tmp_path}/bundle")


def test_captions(spark):
    vtt = "WEBVTT\n\nNOTE x\n\n1\n00:01.000 --> 00:02.500 align:start\n<v A>Hello</v>\nthere\n\n00:03.000 --> 00:04.000\n\n"
    rows = captions.vtt(spark.createDataFrame([("f", vtt)], "file string, content string")).collect()
    assert [(r.idx, r.start_ms, r.end_ms, r.body) for r in rows] == [(1, 1000, 2500, "Hello there")]
    events = {"events": [{"tStartMs": 1000, "dDurationMs": 5000, "segs": [{"utf8": "one "}, {"utf8": "two", "tOffsetMs": 400}]}, {"tStartMs": 2000, "dDurationMs": 10, "aAppend": 1, "segs": [{"utf8": "\n"}]}, {"tStartMs": 3000, "dDurationMs": 500, "segs": [{"utf8": "[Music]"}]}, {"tStartMs": 4000, "dDurationMs": 500, "segs": [{"utf8": "three"}]}, {"tStartMs": 5000, "dDurationMs": 5}]}
    rows = captions.json_captions(spark.createDataFrame([("f", json.dumps(events))], "file string, content string")).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms, r.body) for r in rows] == [(1000, 4000, "one two"), (4000, 4500, "three")]
    chunked = [{"text": "a", "metadata": {"start": "0105"}}, {"text": "b", "metadata": {"start": "x"}}]
    rows = captions.recogniser_chunks(spark.createDataFrame([("f", json.dumps(chunked))], "file string, content string")).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms) for r in rows] == [(65_000, 120_000), (120_000, None)]
    page = "<p>" + "ab " * 700 + "</p>"
    got = spark.range(1).select(captions.slices(F.lit(page)).alias("s"), captions.clean_lines(F.lit("x  y\nAll rights\n\nz"), ["^All"]).alias("c")).first()
    assert [len(s.body) for s in got.s] == [1000, 1000, 99] and got.s[2].start_ms == 120_000 and got.c == "x y\nz"


def test_feeds(spark):
    feed = """<?xml version="1.0"?><rss xmlns:itunes="u"><channel><title><![CDATA[My show]]></title><link>http://s</link>
<item><title>One</title><guid>g1</guid><itunes:duration>1:00:01</itunes:duration><itunes:season>2</itunes:season>
<enclosure url="http://a.mp3"/><podcast:transcript url="h" type="text/html"/><podcast:transcript url="v" type="text/vtt"/><description>&lt;p&gt;x&lt;/p&gt;</description></item>
<item><link>http://l</link></item></channel></rss>"""
    rows = spark.createDataFrame([("f", feed)], "feed string, content string")
    one, two = feeds.episodes(rows).orderBy("idx").collect()
    assert (one.title, one.guid, one.seconds, one.season, one.audio_url, one.notes) == ("One", "g1", 3601, 2, "http://a.mp3", "x")
    assert [t.url for t in one.transcripts] == ["v", "h"]
    assert (two.title, two.guid, two.transcripts) == ("Untitled episode", "http://l", [])
    assert tuple(feeds.channels(rows).first()) == ("f", "My show", "http://s")
    with pytest.raises(Exception, match="no channel"):
        feeds.channels(spark.createDataFrame([("f", "<rss/>")], "feed string, content string")).collect()


def test_ingest_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("A", "The first note is here and it is for you.\n\n" + "b " * 400, None), ("B", "x", "c1")], "title string, text string, collection_id string")
    made = ingest.notes(rows)
    assert made["sources"].count() == made["jobs"].count() == 2 and made["chunks"].count() == made["embeddings"].count() == 3
    show = spark.createDataFrame([("S", "E", None, None, [(0, 900, "This is what the book says about that."), (900, None, "And so it is.")])], "show_title string, episode_title string, episode_url string, language string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>")
    parts = ingest.transcripts(show)
    assert parts["sources"].first().language == "en" and parts["chunks"].count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"title": "A", "text": "hello", "collection_id": None}) + "\n")
    for n in (1, 2):
        landing.ingest_notes(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        (tmp_path / "in" / f"again{n}.json").write_text(json.dumps({"title": "A", "text": "hello", "collection_id": None}) + "\n")
    landing.ingest_notes(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert Store(spark, f"{tmp_path}/out").table("sources").count() == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cut_into_tokens_once_for_all_queries(spark):
    """Ranks come from counts that are written once; they are those of one search for each query."""
    rows = [(i, None, "t", " ".join(f"w{(i * k) % 11}" for k in range(1, 9))) for i in range(40)]
    held = spark.createDataFrame(rows, "doc_id long, language string, tree string, text string")
    asked = ["w1 w2", "w3 w1 w9", "?!"]
    for text, run in zip(asked, keyword.search_each(held, asked, 5)):
        assert [(r.doc_id, r.score) for r in run.collect()] == [(r.doc_id, r.score) for r in keyword.search(held.select("doc_id", "text"), text, 5).collect()]
        assert "regexp_extract_all" not in _plan(run)


def test_notes_are_cut_and_looked_at_once(spark):
    rows = spark.createDataFrame([("a", "the one and the other", None), ("b", "  ", None), ("c", None, None), ("d", "\u00a0und der \n\n eine ", None)], "title string, text string, collection_id string")
    chunks = ingest.notes(rows)["chunks"].select("title", "language", "chunk_index", "text")
    assert sorted(map(tuple, chunks.collect())) == [("a", "en", 1, "the one and the other"), ("d", "de", 1, "und der\n\neine")]
    assert _plan(chunks).count("regexp_extract_all") <= _plan(rows.select(detect(F.col("text"))["language"])).count("regexp_extract_all")
    assert "size(aggregate" not in _plan(chunks)
