"""Payloads as servers send them: chunks, codings, character sets."""

import gzip
import zlib

import pytest
import zstandard

from marginalia.llm import warc

PAGE = "<html><head><title>Ä ß</title></head><body><p>café für</p><a href='/x'>l</a></body></html>"


def chunked(raw, size=7):
    parts = [raw[i : i + size] for i in range(0, len(raw), size)]
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\nTrailer: x\r\n\r\n"


def raw_deflate(raw):
    coder = zlib.compressobj(wbits=-15)
    return coder.compress(raw) + coder.flush()


@pytest.mark.parametrize(
    "head, body",
    [
        ("Content-Type: text/html; charset=ISO-8859-1", PAGE.encode("latin-1")),
        ("content-type: text/html;charset='windows-1252'\r\nContent-Encoding: gzip", gzip.compress(PAGE.encode("cp1252"))),
        ("CONTENT-ENCODING: x-gzip\r\ntransfer-encoding: Chunked", chunked(gzip.compress(PAGE.encode()))),
        ("Content-Encoding: deflate", zlib.compress(PAGE.encode())),
        ("Content-Encoding: deflate", raw_deflate(PAGE.encode())),
        ("Content-Encoding: gzip, zstd", zstandard.compress(gzip.compress(PAGE.encode()))),
        ("Content-Encoding: identity", b"\xef\xbb\xbf" + PAGE.encode()),
        ("X: y", PAGE.encode("utf-16")),
        ("X: y", PAGE.replace("<head>", "<head><meta charset=latin-1>").encode("latin-1")),
        ("Content-Type: text/html; charset=unheard-of", PAGE.encode()),
        ("Content-Type: text/html; charset=base64", PAGE.encode()),
    ],
)
def test_payloads_come_out_as_text(spark, head, body):
    block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body
    rows = spark.createDataFrame([("<urn:a>", "http://a/", "2024-01-01T00:00:00Z", bytearray(block))], "record_id string, target_uri string, warc_date string, block binary")
    meta, text = sorted(warc.derive(rows).collect(), key=lambda r: r.warc_type, reverse=True)
    assert text.block.decode() == "café für\nl" or text.block.decode() == "café fürl" or text.block.decode().replace("\n", "") == "café fürl"
    assert "title: Ä ß\r\noutlink: /x" in meta.block.decode() and "undecoded" not in meta.block.decode()


@pytest.mark.parametrize("head, body", [("Content-Encoding: gzip", b"no gzip"), ("Content-Encoding: br", b"x"), ("Transfer-Encoding: chunked", b"5\r\nab"), ("Content-Encoding: gzip", gzip.compress(b"x" * 99)[:-9])])
def test_what_cannot_be_decoded_is_said(spark, head, body):
    block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body
    rows = spark.createDataFrame([("<urn:a>", "http://a/", "2024-01-01T00:00:00Z", bytearray(block))], "record_id string, target_uri string, warc_date string, block binary")
    meta, text = sorted(warc.derive(rows).collect(), key=lambda r: r.warc_type, reverse=True)
    assert bytes(text.block) == b"" and "undecoded: " in meta.block.decode()


def test_header_names_of_any_case():
    raw = warc.record("metadata", [("WARC-Record-ID", "<urn:a>")], b"abc").replace(b"Content-Length", b"content-length")
    assert [b for _, b in warc.read_records(raw)] == [b"abc"]
