"""Folders of feeds, captions and transcripts as a data source: files are cut into units by the tasks, and Columns parse the units.

``spark.read.format("transcript_units").option("kind", ...).load(folder)`` has a row (file, n, unit, error) for each block of a
caption file (``vtt``), item of a feed (``rss``) or whole JSON file (``json``).  Captions and feeds are streamed, so a task
holds one unit, not a file.  A file that is malformed gives a row with its error beside the units before it; a
store that does not answer fails the task, which is then tried again.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from . import captions, feeds

#: The data source's name.
FORMAT = "transcript_units"

#: Characters of one unit, and bytes of the files of one task, at most; a longer file is a task of its own.
UNIT, TASK = 64 << 20, 128 << 20

_ITEM = re.compile(r"(?s)<item\b[^>]*>.*?</item>")
_ENDINGS = {"vtt": (".vtt",), "rss": (".xml", ".rss"), "json": (".json", ".json3")}
_READ = 1 << 20


class Malformed(ValueError):
    """What is wrong with a file; it becomes a row."""


def _blocks(text: io.TextIOBase) -> Iterator[str]:
    block, size, timed = [], 0, False
    for line in text:
        line = line.rstrip("\r\n")
        if line.strip(" \t"):
            block.append(line)
            size += len(line)
            timed = timed or "-->" in line
            if size > UNIT:
                raise Malformed("a block is too long")
        elif block:
            yield "\n".join(block)
            block, size = [], 0
    if block:
        yield "\n".join(block)
    if not timed:
        raise Malformed("no timing line")


def _items(text: io.TextIOBase) -> Iterator[str]:
    held, channel = "", False
    while part := text.read(_READ):
        held += part
        channel = channel or re.search(r"<channel\b", held) is not None
        end = 0
        for m in _ITEM.finditer(held):
            yield m.group()
            end = m.end()
        held = held[end:]
        open_item = re.search(r"<item\b", held)
        # an item that has begun stays, else a few characters, in which a tag may have
        held = held[open_item.start() :] if open_item else held[-16:]
        if len(held) > UNIT:
            raise Malformed("an item is too long")
    if not channel:
        raise Malformed("no channel in the feed")
    if re.search(r"<item\b", held):
        raise Malformed("an item without an end")


def _whole(text: io.TextIOBase) -> Iterator[str]:
    content = text.read(UNIT + 1)
    if len(content) > UNIT:
        raise Malformed("the file is too long")
    try:
        json.loads(content)
    except ValueError:
        raise Malformed("no JSON") from None
    yield content


_CUTTERS = {"vtt": _blocks, "rss": _items, "json": _whole}


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, folder: str, kind: str, task: int, endings: tuple[str, ...]) -> None:
        self.folder, self.kind, self.task, self.endings, self.only = folder, kind, task, endings, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path[len(root) :].lstrip("/"), f.size or 0) for f in found if f.is_file and f.path.lower().endswith(self.endings))
        out, group, size = [], [], 0
        for name, n in files:
            if self.only is not None and name not in self.only:
                continue
            if group and size + n > self.task:
                out.append(_Files(group))
                group, size = [], 0
            group.append(name)
            size += n
        return [*out, _Files(group)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, root = fs.FileSystem.from_uri(self.folder)
        for name in partition.paths:
            n = 0
            try:
                with store.open_input_stream(f"{root.rstrip('/')}/{name}") as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", newline="\n") as text:
                    for unit in _CUTTERS[self.kind](text):
                        yield name, n, unit, None
                        n += 1
            except (Malformed, UnicodeDecodeError) as e:
                yield name, n, None, str(e) if isinstance(e, Malformed) else "no UTF-8"


class Units(DataSource):
    """Options: path, kind (vtt, rss or json), taskBytes, ending (of file names, instead of the kind's own)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, n int, unit string, error string"

    def reader(self, schema) -> DataSourceReader:
        kind = self.options.get("kind", "")
        if kind not in _CUTTERS:
            raise ValueError(f"kind is one of {', '.join(_CUTTERS)}")
        ending = self.options.get("ending", "").lower()
        return _Reader(self.options["path"], kind, int(self.options.get("taskBytes", TASK)), (ending,) if ending else _ENDINGS[kind])


def units(spark: SparkSession, folder: str, kind: str, task: int = TASK, ending: str = "") -> DataFrame:
    """The units of a folder's files of that kind; a filter on ``file`` keeps other files from being opened."""
    spark.dataSource.register(Units)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("kind", kind).option("taskBytes", str(task)).option("ending", ending).load(folder)


def errors(found: DataFrame) -> DataFrame:
    """(file, error) of the malformed files."""
    return found.where("error IS NOT NULL").select("file", "error")


def vtt_cues(found: DataFrame) -> DataFrame:
    """The rows of ``captions.vtt`` of vtt units."""
    return captions.vtt_blocks(found.where("unit IS NOT NULL").selectExpr("file", "n", "unit AS block"))


def feed_items(found: DataFrame) -> DataFrame:
    """The rows of ``feeds.episodes`` of rss units; ``feed`` is the file."""
    return feeds.episodes_of(found.where("unit IS NOT NULL").selectExpr("file AS feed", "n", "unit AS raw"))


def json_cues(found: DataFrame) -> DataFrame:
    """The rows of ``captions.json_captions`` of json units."""
    return captions.json_captions(found.where("unit IS NOT NULL").selectExpr("file", "unit AS content"))


def recogniser_cues(found: DataFrame) -> DataFrame:
    """The rows of ``captions.recogniser_chunks`` of json units."""
    return captions.recogniser_chunks(found.where("unit IS NOT NULL").selectExpr("file", "unit AS content"))
