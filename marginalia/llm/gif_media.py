"""Media columns for GIF: a container writer, an LZW decoder and frame features.

The decoder follows the format in full: global and local palettes, interlacing,
transparency, the disposal methods and delays.  LZW codes are unpacked by numpy
between two clear codes, since their widths depend only on how many came before.
Literal-only streams, as the writer makes them, need no dictionary; others go
through one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import own_names, plain_names, small_batches

#: Samples in a row of the payload pictures, and rows of one frame.
WIDTH, ROWS = 64, 512

#: Hundredths of a second that the writer shows a frame.
DELAY = 4

#: 8-bit literals between clear codes: the code width stays at 9 bits.
_RUN = 254


@dataclass
class Frame:
    """One shown frame: its place and palette indices, and the whole canvas as RGBA."""

    left: int
    top: int
    start: int  # hundredths of a second since the first frame
    delay: int
    disposal: int
    samples: np.ndarray
    canvas: np.ndarray


def _blocks_of(raw: bytes) -> bytes:
    n = len(raw)
    whole = n // 255 * 255
    grid = np.empty((whole // 255, 256), np.uint8)
    grid[:, 0] = 255
    grid[:, 1:] = np.frombuffer(raw, np.uint8, whole).reshape(-1, 255)
    rest = raw[whole:]
    return grid.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _literal_codes(samples: np.ndarray) -> bytes:
    """An LZW stream of 9-bit literals with a clear code before the width would grow."""
    n = len(samples)
    runs = max(-(-n // _RUN), 1)
    codes = np.full((runs, _RUN + 1), 256, np.uint16)
    padded = np.zeros(runs * _RUN, np.uint16)
    padded[:n] = samples
    codes[:, 1:] = padded.reshape(runs, _RUN)
    line = np.zeros(-(-(n + runs + 1) // 8) * 8, np.uint16)
    line[: n + runs] = codes.ravel()[: n + runs]
    line[n + runs] = 257
    eight = line.reshape(-1, 8)
    nine = np.zeros((len(eight), 9), np.uint8)
    for j in range(9):  # byte j: the top bits of code j - 1 and the low bits of code j
        if j:
            nine[:, j] = eight[:, j - 1] >> (9 - j)
        if j < 8:
            nine[:, j] |= (eight[:, j] << j).astype(np.uint8)
    return nine.tobytes()[: -(-(n + runs + 1) * 9 // 8)]


def _nine_bit(raw: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` codes of 9 bits; ``raw`` has some bytes to spare."""
    groups = -(-count // 8)
    byte = np.zeros(groups * 9, np.uint8)
    byte[: min(len(raw), groups * 9)] = raw[: groups * 9]
    nine = byte.reshape(-1, 9)
    out = np.empty((groups, 8), np.uint16)
    for k in range(8):
        out[:, k] = (nine[:, k] >> k) | (nine[:, k + 1].astype(np.uint16) << (8 - k)) & 0x1FF
    return out.ravel()[:count]


def write_gif(payload: bytes) -> bytes:
    """A lossless GIF of 8-bit samples: the identity grey palette, frames of at most ROWS rows.

    The payload must fill whole rows of WIDTH samples.
    """
    data = np.frombuffer(payload, np.uint8)
    rows = len(data) // WIDTH
    if not rows or len(data) % WIDTH:
        raise ValueError("the payload must be a positive multiple of the row length")
    head = struct.pack("<6sHHBBB", b"GIF89a", WIDTH, min(rows, ROWS), 0xF7, 0, 0)
    out = [head, np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()]
    for top in range(0, rows, ROWS):
        part = data[top * WIDTH : (top + ROWS) * WIDTH]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0, 8))
        out.append(_blocks_of(_literal_codes(part)))
    return b"".join([*out, b"\x3b"])


def _widths(least: int) -> np.ndarray:
    """Bits of the n-th code after a clear code: the table gains an entry by each but the first, up to 4,096."""
    size = (1 << least) + 2 + np.maximum(np.arange(4096 - (1 << least)) - 1, 0)
    return np.minimum(np.maximum(np.ceil(np.log2(size + 1)).astype(np.int64), least + 1), 12)


_ENDS = {k: np.concatenate([[0], np.cumsum(_widths(k))]) for k in range(1, 9)}


def _begins(least: int, many: int) -> np.ndarray:
    """Where the first ``many`` codes after a clear code begin, and the last of them ends: of 12 bits once the table is full."""
    ends = _ENDS[least]
    more = many + 1 - len(ends)
    return ends[: many + 1] if more <= 0 else np.concatenate([ends, ends[-1] + 12 * np.arange(1, more + 1)])


def lzw_decode(stream: bytes, least: int, count: int) -> np.ndarray:
    """``count`` palette indices from an LZW stream with ``least`` bits of root codes.

    A table that is full stays as it is until a clear code.  Codes beyond the table, and
    a stream that ends before ``count`` samples, are an error (ValueError).
    """
    if not 1 <= least <= 8:
        raise ValueError("an LZW code size beyond 1 to 8")
    clear, stop = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8)
    bits = len(stream) * 8
    out: list[np.ndarray] = []
    made, at = 0, 0

    def unpack(begin: np.ndarray, width: np.ndarray) -> np.ndarray:
        byte = begin >> 3
        word = raw[byte].astype(np.uint32) | raw[byte + 1].astype(np.uint32) << 8 | raw[byte + 2].astype(np.uint32) << 16
        return (word >> (begin & 7).astype(np.uint32)) & ((np.uint32(1) << width.astype(np.uint32)) - np.uint32(1))

    if least == 8:
        # runs of one clear code and 254 literals lie 255 codes apart: look at all at once
        stride = (_RUN + 1) * 9
        runs = bits // stride
        if runs:
            grid = _nine_bit(raw, runs * (_RUN + 1)).reshape(runs, _RUN + 1)
            plain = (grid[:, 0] == clear) & (grid[:, 1:] < clear).all(axis=1)
            good = runs if plain.all() else int(np.argmin(plain))
            good = min(good, count // _RUN)
            # the table starts anew only if a clear code or the end follows the last run
            if good and int(unpack(np.array([good * stride]), np.array([9]))[0]) not in (clear, stop):
                good -= 1
            out.append(grid[:good, 1:].astype(np.uint8).ravel())
            made, at = good * _RUN, good * stride
    window = 8192
    while made < count and at + least + 1 <= bits:
        # each code gives a sample at least; one more finds the code that ends the run
        most = min(count - made + 1, (bits - at) // (least + 1), window)
        begin = _begins(least, most)
        n = int(np.searchsorted(begin, bits - at, "right")) - 1
        codes = unpack(at + begin[:n], np.diff(begin[: n + 1]))
        halt = np.flatnonzero((codes == clear) | (codes == stop))
        if not len(halt) and n == window:
            window *= 4
            continue
        used = int(halt[0]) if len(halt) else n
        run = codes[:used]
        if len(run):
            part = run.astype(np.uint8) if int(run.max()) < clear else _expand(run.tolist(), clear)
            out.append(part)
            made += len(part)
        if not len(halt) or codes[used] == stop:
            break
        at += int(begin[used + 1])
    got = np.concatenate(out)[:count] if out else np.zeros(0, np.uint8)
    if len(got) < count:
        raise ValueError("an LZW stream that ends early")
    return got


def _expand(codes: list[int], clear: int) -> np.ndarray:
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    previous, parts = b"", []
    for code in codes:
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("an LZW code beyond the table")
        if previous and len(table) < 4096:
            table.append(previous + entry[:1])
        parts.append(entry)
        previous = entry
    return np.frombuffer(b"".join(parts), np.uint8)


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(a, rows, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(raw: bytes) -> list[Frame]:
    """All frames, composed by disposal method and transparency.

    Parts of a frame beyond the canvas are not shown.  Bytes that are no GIF, or a GIF
    that is cut off, are an error (ValueError).
    """
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _frames(raw)
    except (IndexError, struct.error) as cut:
        raise ValueError("a GIF that is cut off") from cut


def _frames(raw: bytes) -> list[Frame]:
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at = 13
    common = None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), np.uint8)
    frames: list[Frame] = []
    delay, disposal, clear_index, start = 0, 0, -1, 0
    while at < len(raw) and raw[at] != 0x3B:
        kind = raw[at]
        if kind == 0x21:
            if raw[at + 1] == 0xF9:
                control, delay, index = struct.unpack_from("<BHB", raw, at + 3)
                disposal, clear_index = control >> 2 & 7, index if control & 1 else -1
            at += 2
            while raw[at]:
                at += raw[at] + 1
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", raw, at + 1)
        at += 10
        palette = common
        if local & 0x80:
            n = 2 << (local & 7)
            palette = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        least = raw[at]
        at += 1
        parts = []
        while raw[at]:
            parts.append(raw[at + 1 : at + 1 + raw[at]])
            at += raw[at] + 1
        at += 1
        samples = lzw_decode(b"".join(parts), least, w * h).reshape(h, w)
        if local & 0x40:
            straight = np.empty_like(samples)
            straight[_interlaced(h)] = samples
            samples = straight
        if palette is None:
            raise ValueError("a frame without a palette")
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        inside = samples[: area.shape[0], : area.shape[1]]
        colours = np.full((max(256, len(palette)), 4), 255, np.uint8)
        colours[: len(palette), :3] = palette
        if clear_index >= 0:
            solid = inside != clear_index
            area[solid] = colours[inside[solid]]
        else:
            area[:] = colours[inside]
        frames.append(Frame(left, top, start, delay, disposal, samples, canvas.copy()))
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas[:] = before
        start += delay
        delay, disposal, clear_index = 0, 0, -1
    return frames


def histogram(frame: Frame) -> list[int]:
    """Pixels of the canvas in each of 4 x 4 x 4 colour cells, red first; unset pixels count nowhere."""
    red, green, blue, alpha = (frame.canvas[:, :, c] for c in range(4))
    cell = (red >> 6 << 4) | (green >> 6 << 2) | (blue >> 6)
    cell[alpha == 0] = 64
    return np.bincount(cell.ravel(), minlength=65)[:64].tolist()


_FRAMES = "frame int, start int, delay int, disposal int, width int, height int, samples binary, colours array<long>"


def frames_of(media: DataFrame) -> DataFrame:
    """One row per frame of the GIFs in column ``media``, with the other columns.

    frame (from 0), start and delay (hundredths of a second), disposal, width, height,
    samples (palette indices, row by row) and colours (histogram of the canvas as
    shown).  Null media give no rows; bytes that are no GIF are an error.
    """
    small_batches(media.sparkSession)
    added = ["frame", "start", "delay", "disposal", "width", "height", "samples", "colours"]
    media, named = plain_names(media.drop(*added), "media")
    rest = [c for c in media.columns if c != "media"]
    kinds = {f.name: f.dataType.simpleString() for f in media.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(0).to_pylist()):
                shown = read_gif(raw) if raw is not None else []
                if not shown:
                    continue
                same = pa.array([i] * len(shown))
                cols = [
                    pa.array(range(len(shown)), pa.int32()),
                    pa.array([f.start for f in shown], pa.int32()),
                    pa.array([f.delay for f in shown], pa.int32()),
                    pa.array([f.disposal for f in shown], pa.int32()),
                    pa.array([f.samples.shape[1] for f in shown], pa.int32()),
                    pa.array([f.samples.shape[0] for f in shown], pa.int32()),
                    pa.array([f.samples.tobytes() for f in shown], pa.binary()),
                    pa.array([histogram(f) for f in shown], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([*(c.take(same) for c in batch.columns[1:]), *cols], names=[*rest, *added])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in rest), _FRAMES])
    return own_names(media.select("media", *rest).mapInArrow(run, schema), named)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text as a GIF, its UTF-8 padded with zero bytes to whole rows.

    Null and empty texts make one row of zeros.  Other columns are left out; repeated
    rows are kept.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [b or b"" for b in batch.column(1).cast(pa.large_binary()).to_pylist()]
            media = [write_gif(b + bytes(-len(b) % WIDTH or (0 if b else WIDTH))) for b in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(b) for b in raws], pa.int64()), pa.array(media, pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and, from the stored bytes alone, digests of payload and medium and a feature.

    The payload is the red channel of every frame as it is shown, in order; the feature
    names frames, time and the summed colour histogram over its four grey cells.  Null
    media have nulls in all of these; a GIF without frames has an empty payload.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(2).to_pylist():
                if raw is None:
                    out.append((None,) * 6)
                    continue
                shown = read_gif(raw)
                payload = b"".join(
                    f.canvas[f.top : f.top + f.samples.shape[0], f.left : f.left + f.samples.shape[1], 0].tobytes() for f in shown
                )
                total = np.sum([np.zeros(64, int), *(histogram(f) for f in shown)], axis=0)
                ticks = shown[-1].start + shown[-1].delay if shown else 0
                feature = f"frames={len(shown)};ticks={ticks};grey=" + ",".join(str(total[21 * k]) for k in range(4))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
