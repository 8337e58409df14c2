import base64
import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from marginalia.llm import byte_bpe, gif_media, queries, warc
from marginalia.llm.queries import pattern, vocabulary

TEXTS = [None, "", " ", "Hello  world!\n\n\tit's", "naïve 🦜 语言 été", "<|endoftext|>", "a" * 5000, "x \x1c\x85\u00a0y", "\U0001f1e9\U0001f1ea e\u0301"]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Codec(vocabulary(), pattern())


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_other_library(coder, reference, monkeypatch):
    texts = [t or "" for t in TEXTS] + ["".join(map(chr, range(i, i + 97))) for i in range(0, 0x3000, 97)]
    want = [reference.encode_ordinary(t) for t in texts]
    assert coder.encode(texts) == want
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    assert coder.encode(texts) == want
    assert [coder.decode(x).decode() for x in want] == texts


def test_offsets_cover_split_characters(coder):
    text = "été 🦜!"
    ids = coder.encode([text])[0]
    starts, ends = coder.offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text)
    for token, a, b in zip(ids, starts, ends):
        assert coder.bytes[token] in text[a:b].encode()


def test_documents(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    rows = byte_bpe.encode_documents(docs, vocabulary, pattern(), ("n_tokens", "ids", "starts", "ends", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.decoded == text and r.n_tokens == len(r.ids) == len(r.starts)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, vocabulary, pattern()), vocabulary, pattern())
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def lzw(samples, least, defer=False):
    """A plain compressing encoder, to test the decoder's dictionary; with ``defer`` a full table stays."""
    clear, out, nbits, acc = 1 << least, bytearray(), 0, 0

    def put(code, width):
        nonlocal acc, nbits
        acc |= code << nbits
        nbits += width
        while nbits >= 8:
            out.append(acc & 255)
            acc >>= 8
            nbits -= 8

    table, width = {bytes([i]): i for i in range(clear)}, least + 1
    put(clear, width)
    word, nxt = b"", clear + 2
    for s in samples:
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        put(table[word], width)
        if nxt < 4096:
            table[word + bytes([s])] = nxt
            nxt += 1
            if nxt > 1 << width and width < 12:
                width += 1
        elif not defer:
            put(clear, width)
            table, width, nxt = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2
        word = bytes([s])
    put(table[word], width)
    if nxt < 4096 and nxt + 1 > 1 << width and width < 12:
        width += 1
    put(clear + 1, width)
    if nbits:
        out.append(acc & 255)
    return bytes(out)


@pytest.mark.parametrize("least", [2, 4, 8])
def test_lzw_streams(least):
    rng = np.random.default_rng(least)
    for n in (1, 2, 300, 20000):
        for samples in (rng.integers(0, 1 << least, n), np.zeros(n, int), np.arange(n) // 7 % (1 << least)):
            samples = samples.astype(np.uint8)
            assert (gif_media.lzw_decode(lzw(samples.tolist(), least), least, n) == samples).all()


@pytest.mark.parametrize("least", [2, 8])
def test_a_full_table_stays_until_a_clear_code(least):
    for n in (6000, 20000, 60000):
        samples = np.random.default_rng(n).integers(0, 1 << least, n).astype(np.uint8)
        assert (gif_media.lzw_decode(lzw(samples.tolist(), least, True), least, n) == samples).all()


def test_streams_that_end_early_are_an_error():
    stream = lzw([1, 2, 3] * 50, 2)
    for bad in (stream[:10], b""):
        with pytest.raises(ValueError):
            gif_media.lzw_decode(bad, 2, 150)
    whole = gif_media.write_gif(bytes(640))
    for bad in (b"", b"GIF89a", whole[:-20], b"PNG" + whole):
        with pytest.raises(ValueError):
            gif_media.read_gif(bad)


def test_payload_round_trip():
    for n in (64, 128, 254 * 64, 64 * 512, 64 * 1300):
        payload = bytes(i * 7 % 256 for i in range(n))
        frames = gif_media.read_gif(gif_media.write_gif(payload))
        assert b"".join(f.samples.tobytes() for f in frames) == payload
        assert len(frames) == -(-n // (64 * 512))
    with pytest.raises(ValueError):
        gif_media.write_gif(b"x")


def test_disposal_transparency_and_interlace():
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])

    def frame(w, h, left, top, samples, disposal, clear=None, local=0):
        control = disposal << 2 | (clear is not None)
        data = lzw(samples, 2)
        return (
            bytes([0x21, 0xF9, 4, control, 5, 0, clear or 0, 0, 0x2C, left, 0, top, 0, w, 0, h, 0, local, 2, len(data)]) + data + b"\0"
        )

    raw = b"GIF89a" + bytes([4, 0, 4, 0, 0x81, 0, 0]) + palette
    raw += frame(4, 4, 0, 0, [0] * 16, 1)
    raw += frame(2, 2, 0, 0, [1, 3, 3, 1], 3, clear=3)
    raw += frame(2, 2, 2, 2, [2] * 4, 2)
    raw += frame(1, 4, 0, 0, [0, 1, 2, 3], 0, local=0x40) + b"\x3b"
    a, b, c, d = gif_media.read_gif(raw)
    assert (a.canvas[:, :, 0] == 255).all()
    assert b.canvas[0, 0].tolist() == [0, 255, 0, 255] and b.canvas[0, 1].tolist() == [255, 0, 0, 255]
    assert c.canvas[0, 0].tolist() == [255, 0, 0, 255] and c.canvas[3, 3].tolist() == [0, 0, 255, 255]
    assert d.canvas[3, 3].tolist() == [0, 0, 0, 0] and d.samples[:, 0].tolist() == [0, 2, 1, 3]
    assert [f.start for f in (a, b, c, d)] == [0, 5, 10, 15]
    assert sum(gif_media.histogram(d)) == 12


def test_media_columns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    stored = gif_media.store_texts(docs)
    rows = gif_media.media_digests(stored).collect()
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    media = stored.withColumnRenamed("media", "media").withColumn("frame", stored.doc_id)
    shown = gif_media.frames_of(media).collect()
    assert len(shown) == len(TEXTS) and all(sum(r.colours) == r.width * r.height for r in shown)
    assert gif_media.media_digests(gif_media.store_texts(docs.limit(0))).count() == 0


def test_null_and_frameless_media(spark):
    bare = b"GIF89a" + bytes([4, 0, 4, 0, 0x80, 0, 0]) + bytes(6) + b"\x3b"
    rows = gif_media.media_digests(spark.createDataFrame([(1, 0, None), (2, 0, bare)], "doc_id long, n_bytes long, media binary")).collect()
    none, empty = sorted(rows, key=lambda r: r.doc_id)
    assert none.payload_sha256 is None and none.feature is None and none.media_bytes is None
    assert (empty.payload_bytes, empty.media_bytes, empty.tail_crc32) == (0, len(bare), 0) and empty.feature == "frames=0;ticks=0;grey=0,0,0,0"
    over = b"GIF89a" + bytes([2, 0, 2, 0, 0x80, 0, 0]) + bytes([0, 0, 0, 255, 255, 255])
    data = lzw([1] * 16, 2)
    over += bytes([0x2C, 1, 0, 1, 0, 4, 0, 4, 0, 0, 2, len(data)]) + data + b"\0\x3b"
    assert gif_media.read_gif(over)[0].canvas[:, :, 3].tolist() == [[0, 0], [0, 255]]


def test_a_text_over_a_mebibyte(spark):
    text = "é" + "".join(chr(33 + i * 7919 % 90) for i in range(1_200_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    raw = text.encode()
    row = gif_media.media_digests(gif_media.store_texts(docs)).first()
    assert row.n_bytes == len(raw) and row.payload_sha256 == hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest()


def test_warc_derivatives(spark):
    page = '<html><head><title> A &amp; B </title></head><body><script>no()</script><p>one <b>two</b></p><a href="/x?a=1&amp;b=2">three</a></body></html>'
    rows = [(1, "http://a/", page), (1, "http://a/", page), (2, None, None), (None, "http://b/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    source = warc.responses_of(pages)
    made = warc.derive(source.withColumn("warc_type", source.page_id)).collect()
    assert len(made) == 8
    first = [r for r in made if r.page_id == 1]
    refers = {r.record_id for r in source.collect()}
    assert {r.refers_to for r in made} == refers and len({r.record_id for r in made}) == 6
    text = next(r for r in first if r.warc_type == "conversion")
    meta = bytes(next(r for r in first if r.warc_type == "metadata").block).decode()
    assert bytes(text.block).decode() == "one two\nthree" and text.payload_digest == warc.digest(page.encode())
    assert "title: A & B\r\n" in meta and "outlink: /x?a=1&b=2\r\n" in meta and "http-content-type: text/html; charset=utf-8\r\n" in meta
    raw = b"".join(bytes(r.raw) for r in warc.as_records(warc.derive(source)).collect())
    records = [(dict(f), b) for f, b in warc.read_records(raw)]
    assert len(records) == 8 and all(f["WARC-Refers-To"] in refers and f["WARC-Block-Digest"] == warc.digest(b) for f, b in records)
    assert all(f["Source-HTTP-status"] == "HTTP/1.1 200 OK" and f["Source-HTTP-Content-Type"].startswith("text/html") for f, _ in records)
    assert {f["Source-Payload-Digest"] for f, _ in records} == {warc.digest(page.encode()), warc.digest(b"")}
    assert warc.derive(warc.responses_of(pages.limit(0))).count() == 0


def test_warc_edges(spark, tmp_path):
    block = b"HTTP/1.1 404 Not\r\nX-A: 1\r\nx-a: 2\r\n\r\n<p title=\"a > b\">seen</p><p class='x\">'>also</p> <b broken=\"x>end"
    rows = [(None, "http://x/\r\nEvil: 1", "d", block, None, 1), (None, None, None, None, None, 2), (None, None, None, None, None, 3), ("<id>", "http://y/", "d\r\nEvil: 2", b"no header end", "sha1:known", 4)]
    source = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, block binary, payload_digest string, raw int")
    made = warc.derive(source)
    got = [r.asDict() for r in made.collect()]
    text = [bytes(r["block"]).decode() for r in got if r["warc_type"] == "conversion" and r["raw"] == 1]
    assert text == ["seen\nalso\nend"] and {r["payload_digest"] for r in got if r["raw"] == 4} == {"sha1:known"}
    assert len({r["record_id"] for r in got if r["raw"] == 1} | {r["record_id"] for r in got if r["raw"] == 2}) == 4
    back = warc.parsed(warc.as_records(made.drop("raw"))).collect()
    assert len(back) == 8 and all(r.sound for r in back) and not any("Evil" in h.name for r in back for h in r.source_headers)
    assert {r.target_uri for r in back} == {"http://x/%0D%0AEvil: 1", "", "http://y/"}
    assert [[(h.name, h.value) for h in r.source_headers] for r in back if "x/" in r.target_uri][0] == [("status", "HTTP/1.1 404 Not"), ("X-A", "1"), ("x-a", "2")]
    at_once = warc.round_trip(source.withColumnRenamed("raw", "n")).collect()
    assert sorted(str(r) for r in at_once) == sorted(str(r) for r in warc.parsed(warc.as_records(made.withColumnRenamed("raw", "n"))).collect())
    path = f"file://{tmp_path}/warcs"
    warc.write_warcs(made.repartition(3), path)
    warc.write_warcs(made.repartition(3), path)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    again = warc.parsed(files.withColumnRenamed("content", "raw"))
    assert sorted((r.record_id, bytes(r.block)) for r in again.collect()) == sorted((r["record_id"], bytes(r["block"])) for r in got)
    with pytest.raises(ValueError):
        list(warc.read_records(warc.record("metadata", [], b"abc")[:-6]))


def test_warc_query_matches_plain_code(spark, tmp_path):
    """op5 against the records made by hand from the pages."""
    pages = [(i, f"http://h/{i}" if i % 3 else None, f"<head><title>T{i}</title></head><p>text {i} &lt;x&gt;</p><a href='/l{i}'>l</a>" if i % 4 else None) for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.warc_type): r for r in queries.op5_warc(spark, str(tmp_path)).collect()}
    assert len(got) == 24
    for i, url, page in pages:
        payload = (page or "").encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        text = f"text {i} <x>\nl" if page else ""
        meta = f"status: HTTP/1.1 200 OK\r\nhttp-content-type: text/html; charset=utf-8\r\nhttp-content-length: {len(payload)}\r\npayload-digest: {warc.digest(payload)}\r\nblock-digest: {warc.digest(block)}\r\ntitle: {f'T{i}' if page else ''}\r\n" + (f"outlink: /l{i}\r\n" if page else "")
        for kind, want in (("conversion", text), ("metadata", meta)):
            r = got[i, kind]
            assert r.block_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.content_length == len(want.encode()) and r.sound
            assert r.target_uri == (url or "") and r.payload_digest == warc.digest(payload) and r.source_block_digest == warc.digest(block)
            assert r.source_headers.split("\n")[0] == "status: HTTP/1.1 200 OK" and r.refers_to.startswith("<urn:uuid:")
