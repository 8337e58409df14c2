"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A derived record names its source in WARC-Refers-To and keeps its target URI, date and
digests.  Record identifiers are made from the source's identifier by rule, so a rerun
gives the same records.  Writing and parsing of the record format live here as well.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import small_batches

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_SKIP = re.compile(r"<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_HEAD = re.compile(r"<head\b.*?</head\s*>", re.S | re.I)
_BLOCKS = "address|article|aside|blockquote|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul"
# a tag ends behind its attributes, whose values may hold any character; with an open quote, at the next >
_BREAK = re.compile(rf"<(?:/?(?:{_BLOCKS})\b|br\b)(?:{_ATTRIBUTES}|[^>]*>)", re.I)
_TAG = re.compile(rf"</?[a-z!](?:{_ATTRIBUTES}|[^>]*>)", re.I)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.S | re.I)


def digest(raw: bytes) -> str:
    """A labelled digest in the form that WARC headers use."""
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def plain_text(page: str) -> tuple[str, str, list[str]]:
    """Title, visible text (a line for each block, white space collapsed) and link targets."""
    body = _SKIP.sub(" ", page)
    title = _TITLE.search(body)
    links = [html.unescape(a or b or c) for a, b, c in _LINK.findall(body)]
    shown = _TAG.sub("", _BREAK.sub("\n", _HEAD.sub("", body)))
    lines = (" ".join(line.split()) for line in html.unescape(shown).split("\n"))
    return " ".join(html.unescape(_TAG.sub("", title[1])).split()) if title else "", "\n".join(x for x in lines if x), links


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    fields = [(a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in lines[1:]) if b]
    return lines[0], fields, payload


def unchunked(body: bytes) -> bytes:
    """A body without the framing of chunks; ValueError if it is cut off or no such body."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunked body that is cut off")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0 or end + 2 + size > len(body):
            raise ValueError("a chunk that is cut off")
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _inflated(body: bytes, coding: str) -> bytes:
    if coding in ("gzip", "x-gzip"):
        return gzip.decompress(body)
    if coding == "deflate":  # with the wrapper that the standard names, or without it
        try:
            return zlib.decompress(body)
        except zlib.error:
            return zlib.decompress(body, -zlib.MAX_WBITS)
    if coding == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    raise ValueError(f"unknown content coding {coding}")


_CHARSET = re.compile(rb"""<meta\b[^>]{0,200}?\bcharset\s*=\s*["']?([A-Za-z0-9_:.-]+)""", re.I)


def payload_text(fields: list[tuple[str, str]], payload: bytes) -> str:
    """The text of a response's payload: framing and codings off, decoded by its character set.

    The set is that of a byte order mark, of Content-Type, of a meta tag within the first 1024 bytes, else UTF-8;
    names that are not known count as UTF-8, bytes that do not fit as replacement characters.  A payload whose framing or
    coding is broken or not known is a ValueError.
    """
    told: dict[str, list[str]] = {}
    for name, value in fields:
        told.setdefault(name.lower(), []).extend(v.strip().lower() for v in value.split(","))
    try:
        if "chunked" in told.get("transfer-encoding", []):
            payload = unchunked(payload)
        for coding in reversed([c for c in told.get("content-encoding", []) if c not in ("", "identity")]):
            payload = _inflated(payload, coding) if payload else payload
    except (OSError, EOFError, zlib.error, zstandard.ZstdError) as e:
        raise ValueError(str(e)) from None
    if payload.startswith(codecs.BOM_UTF8):
        return payload[3:].decode("utf-8", "replace")
    if payload[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        return payload.decode("utf-16", "replace")
    named = re.search(r"""charset\s*=\s*["']?([a-z0-9_:.-]+)""", ",".join(told.get("content-type", [])))
    inside = _CHARSET.search(payload[:1024])
    charset = named[1] if named else inside[1].decode() if inside else "utf-8"
    try:
        return payload.decode(charset, "replace")
    except (LookupError, ValueError):  # no such set, or none of text
        return payload.decode("utf-8", "replace")


def _line(value: str) -> str:
    """A header value on one line; line breaks become spaces."""
    return " ".join(value.split("\r\n")).replace("\r", " ").replace("\n", " ").strip()


def _uri(value: str) -> str:
    """A URI without the characters that would end a header line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record; fields without a value are left out."""
    head = [("WARC-Type", kind), *((k, _line(v)) for k, v in fields if v), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def read_records(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers, in order, and block of every record, of plain bytes or gzip members."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError("not a WARC record")
        lines = raw[at:end].decode("utf-8").split("\r\n")
        fields = [(a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in lines[1:])]
        size = int(next(v for k, v in fields if k.lower() == "content-length"))
        if end + 4 + size > len(raw):
            raise ValueError("a WARC record that is cut off")
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


_COLUMNS = ["warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "source_block_digest", "source_headers", "block_digest", "content_length", "block"]
_KINDS = {"content_length": "long", "block": "binary", "source_headers": "array<struct<name:string,value:string>>"}
_ARROW = {"content_length": pa.int64(), "block": pa.binary(), "source_headers": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))}
_DERIVED = ", ".join(f"{c} {_KINDS.get(c, 'string')}" for c in _COLUMNS)


def _headers(lists: list[list[tuple[str, str]]]) -> pa.Array:
    """Lists of (name, value) as a column, from flat arrays."""
    flat = [h for one in lists for h in one]
    items = pa.StructArray.from_arrays([pa.array([n for n, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string())], names=["name", "value"])
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def _table(rows: list[tuple], names: list[str]) -> list[pa.Array]:
    cols = list(zip(*rows)) or [()] * len(names)
    return [_headers(list(c)) if n == "source_headers" else pa.array(list(c), _ARROW.get(n, pa.string())) for n, c in zip(names, cols)]


def _derived(rid: str | None, uri: str | None, date: str | None, block: bytes | None, known: str | None) -> Iterator[tuple]:
    """The metadata record and the conversion record of a response, as tuples in the order of _COLUMNS."""
    raw = block or b""
    status, fields, payload = split_http(raw)
    source, whole = known or digest(payload), digest(raw)
    try:
        (title, text, links), undecoded = plain_text(payload_text(fields, payload)), []
    except ValueError as e:
        title, text, links, undecoded = "", "", [], [("undecoded", str(e))]
    name = rid or f"{uri} {date} {whole}"
    lines = [("status", status), *((f"http-{k.lower()}", v) for k, v in fields), ("payload-digest", source), ("block-digest", whole), *undecoded, ("title", title), *(("outlink", x) for x in links)]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines).encode("utf-8", "replace")
    headers = [("status", status), *fields]
    for kind, mime, made in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {name}')}>"
        yield kind, own, rid or "", _uri(uri or ""), date or "", mime, source, whole, headers, digest(made), len(made), made


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response: metadata, then conversion.

    ``responses`` has record_id, target_uri, warc_date, block (an HTTP response) and, if
    known, payload_digest; other columns stay.  The metadata record holds the source's
    HTTP headers, digests, title and links as ``name: value`` lines; the conversion record the
    text as UTF-8, of a payload without chunks and codings and by its own character set (``payload_text``); of a
    payload that cannot be decoded it is empty, and the metadata have a line ``undecoded``.  Both keep the source's identifier (refers_to), payload digest, block
    digest, status and HTTP headers.  A null block counts as empty and still gives both
    records; nulls elsewhere become empty.  A source without an identifier gives its
    records identifiers by its URI, date and content.  Columns named like the record's are replaced.
    """
    small_batches(responses.sparkSession)
    need = ["record_id", "target_uri", "warc_date", "block", "payload_digest"]
    if "payload_digest" not in responses.columns:
        responses = responses.withColumn("payload_digest", F.lit(None).cast("string"))
    rest = [c for c in responses.columns if c not in {*need, *_COLUMNS}]
    kinds = {f.name: f.dataType.simpleString() for f in responses.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for one in zip(*(c.to_pylist() for c in batch.columns[:5])) for row in _derived(*one)]
            twice = pa.array(np.repeat(np.arange(batch.num_rows), 2))
            yield pa.RecordBatch.from_arrays([*(c.take(twice) for c in batch.columns[5:]), *_table(out, _COLUMNS)], names=[*rest, *_COLUMNS])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), _DERIVED])
    return responses.select(*need, *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def responses_of(pages: DataFrame) -> DataFrame:
    """Response records for stored pages (page_id, url, html): identifiers and dates by rule."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, blocks, digests = [], [], [], []
            for page, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (body or "").encode()
                ids.append(f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response {page} {url}')}>")
                urls.append(url)
                blocks.append(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload)
                digests.append(digest(payload))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.string()), pa.array(urls, pa.string()), pa.array(["2024-01-01T00:00:00Z"] * len(ids), pa.string()), pa.array(blocks, pa.binary()), pa.array(digests, pa.string())],
                names=["page_id", "record_id", "target_uri", "warc_date", "block", "payload_digest"],
            )

    schema = "page_id long, record_id string, target_uri string, warc_date string, block binary, payload_digest string"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)


#: The header of each column; the source's own headers go into fields that begin with SOURCE.
_HEADERS = {
    "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type",
    "payload_digest": "Source-Payload-Digest", "source_block_digest": "Source-Block-Digest",
}
SOURCE = "Source-HTTP-"


def _bytes_of(kind: str, values: tuple, headers: list[tuple[str, str]], block: bytes | None) -> bytes:
    """The record of one derived row; ``values`` by the columns of _HEADERS."""
    fields = [(h, v or "") for h, v in zip(_HEADERS.values(), values)]
    return record(kind, fields + [(SOURCE + n, v or "") for n, v in headers], block or b"")


def _rows_of(raw: bytes) -> Iterator[tuple]:
    """The rows of the records in some bytes, in the order of _COLUMNS, and whether each block has the stated digest."""
    for fields, block in read_records(raw):
        got = dict(fields)
        headers = [(k[len(SOURCE) :], v) for k, v in fields if k.startswith(SOURCE)]
        stated = got.get("WARC-Block-Digest")
        yield (got.get("WARC-Type"), *(got.get(h, "") for h in _HEADERS.values()), headers, stated, len(block), block, stated == digest(block))


def as_records(derived: DataFrame) -> DataFrame:
    """Each derived record's bytes in ``raw``, ready to be written one after another; columns beside the record's stay."""
    need = ["warc_type", *_HEADERS, "source_headers", "block"]
    rest = [c for c in derived.columns if c not in {*_COLUMNS, "raw"}]
    kinds = {f.name: f.dataType.simpleString() for f in derived.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[: len(need)]))
            raw = [_bytes_of(kind, values, [(h["name"], h["value"]) for h in headers or []], block) for kind, *values, headers, block in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[len(need) :], pa.array(raw, pa.binary())], names=[*rest, "raw"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "raw binary"])
    return derived.select(*need, *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def _read_back(rest: list[str]):
    """(raw, rest) -> a row a record."""
    names = [*_COLUMNS, "sound"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, row) for i, raw in enumerate(batch.column(0).to_pylist()) if raw is not None for row in _rows_of(raw)]
            same = pa.array([i for i, _ in found], pa.int64())
            cols = _table([r[:-1] for _, r in found], _COLUMNS)
            yield pa.RecordBatch.from_arrays([*(c.take(same) for c in batch.columns[1:]), *cols, pa.array([r[-1] for _, r in found], pa.bool_())], names=[*rest, *names])

    return run


def parsed(files: DataFrame) -> DataFrame:
    """One row a record of the bytes in ``raw`` (a record, a file or gzip members), with the columns that ``derive`` gives.

    Other columns stay.  ``sound`` tells whether the block has the digest that its header
    states.  Null bytes give no rows; bytes that are no records are an error.
    """
    small_batches(files.sparkSession)
    rest = [c for c in files.columns if c not in {*_COLUMNS, "sound", "raw"}]
    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), _DERIVED, "sound boolean"])
    return files.select("raw", *[F.col(f"`{c}`") for c in rest]).mapInArrow(_read_back(rest), schema)


def round_trip(responses: DataFrame) -> DataFrame:
    """``parsed(as_records(derive(responses)))`` by one worker, not three in a row."""
    small_batches(responses.sparkSession)
    need = ["record_id", "target_uri", "warc_date", "block", "payload_digest"]
    rest = [c for c in responses.columns if c not in {*need, *_COLUMNS, "sound", "raw"}]
    kinds = {f.name: f.dataType.simpleString() for f in responses.schema.fields}
    back = _read_back(rest)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_bytes_of(r[0], r[1:8], r[8], r[11]) for one in zip(*(c.to_pylist() for c in batch.columns[:5])) for r in _derived(*one)]
            twice = pa.array(np.repeat(np.arange(batch.num_rows), 2))
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), *(c.take(twice) for c in batch.columns[5:])], names=["raw", *rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return back(written(batches))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), _DERIVED, "sound boolean"])
    return responses.select(*need, *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def write_warcs(derived: DataFrame, path: str) -> None:
    """Write derived records as ``part-<id>.warc.gz`` files, a gzip member a record, a file a task.

    A task writes under a name of its own attempt and renames it at the end by its partition,
    so a task that is run again leaves one file.
    """
    from pyarrow import fs
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        temp = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(temp) as out:
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    out.write(gzip.compress(raw, mtime=0))
        store.move(temp, f"{root}/part-{part:06d}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], names=["done"])

    as_records(derived).select("raw").mapInArrow(run, "done long").count()
