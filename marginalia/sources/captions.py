"""Captions and transcripts: VTT, JSON captions and recogniser output to timed segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html_flat, collapse, mmss_to_ms, references, timestamp_ms, unescape, without_tags, woven

_CUES = "events array<struct<tStartMs:double,dDurationMs:double,aAppend:int,segs:array<struct<utf8:string,tOffsetMs:double>>>>"


#: Blank lines part the blocks of a caption text.
_BLANK = r"\r?\n[ \t]*\r?\n"


def _block(block: Column) -> tuple[Column, Column, Column, Column]:
    """Has a block a timing line, what are its start and end, and what does it say, tags and references included?"""
    return (
        block.rlike(r"[\d:.,]+[ \t]+-->[ \t]+[\d:.,]+"), F.regexp_extract(block, r"([\d:.,]+)[ \t]+-->", 1),
        F.regexp_extract(block, r"-->[ \t]+([\d:.,]+)", 1), F.regexp_extract(block, r"(?s)-->[^\n]*\n(.*)$", 1),
    )


def with_cues(rows: DataFrame, content: str, name: str) -> DataFrame:
    """``rows`` with the cues of ``vtt`` as an array<struct<start_ms, end_ms, text>>; null texts have none.

    A text is cut and cleaned in its own row: nothing is shuffled.
    """

    def parts(block: Column) -> Column:
        # short strings, so that times are not looked for in the whole block again and again
        _, start, end, body = _block(block)
        return F.struct(start.alias("start"), end.alias("end"), body.alias("body"))

    def cue(c: Column) -> Column:
        return F.struct(timestamp_ms(c["start"]).alias("start_ms"), timestamp_ms(c["end"]).alias("end_ms"), without_tags(c["body"]).alias("text"))

    def clean(decoded: Column) -> Column:
        # what a lambda is given is computed once, however often it is named
        plain = F.transform("cues_", lambda c: F.struct(c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), woven(c["text"], decoded).alias("text")))
        said = F.transform(plain, lambda c: F.struct(c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), collapse(c["text"]).alias("text")))
        return F.filter(said, lambda c: c["text"] != "")

    timed = F.filter(F.split(content, _BLANK), lambda b: F.contains(b, F.lit("-->")) & _block(b)[0])
    rows = rows.withColumn("cues_", F.transform(F.transform(timed, parts), cue))
    refs, decoded = references(F.transform("cues_", lambda c: c["text"]))
    rows = rows.withColumn("refs_", refs).withColumn("decoded_", decoded)
    return rows.withColumn(name, clean(F.map_from_arrays("refs_", "decoded_"))).drop("cues_", "refs_", "decoded_")


def vtt(files: DataFrame) -> DataFrame:
    """(file, idx, start_ms, end_ms, body) of VTT texts (file, content); cues without text go."""
    return vtt_blocks(files.select("file", F.posexplode(F.split("content", _BLANK)).alias("n", "block")))


def vtt_blocks(blocks: DataFrame) -> DataFrame:
    """The same of blocks (file, n, block) between blank lines."""
    timed, start, end, body = _block(F.col("block"))
    rows = blocks.where(timed).select("file", "n", timestamp_ms(start).alias("start_ms"), timestamp_ms(end).alias("end_ms"), clean_html_flat(body).alias("body")).where("body <> ''")
    return rows.select("file", F.expr("row_number() OVER (PARTITION BY file ORDER BY n)").alias("idx"), "start_ms", "end_ms", "body")


#: What begins a line of a caption file that belongs to no cue.
ASIDES = ("NOTE", "STYLE", "REGION")


def vtt_lines(files: DataFrame) -> DataFrame:
    """(file, idx, start_ms, end_ms, body) of caption texts (file, content), read line by line.

    For files whose cues need no blank lines between: a timing line, a blank one and one
    of a note, style or region end the cue before.  Numbers alone are no text, tags go, and a
    time that cannot be read is 0.  Cues without text go.
    """
    line = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.array().cast("array<string>").alias("text"))
    begin = F.struct(F.array().cast("array<struct<start:bigint,end:bigint,body:string>>").alias("done"), line.alias("cue"))

    def closed(acc: Column) -> Column:
        """The finished cues, the open one among them if it has text."""
        texts = F.filter(F.transform(acc["cue"]["text"], lambda x: F.when(x.rlike(r"^\d+$"), "").otherwise(F.trim(F.regexp_replace(x, "<[^>]+>", "")))), lambda x: x != "")
        body = F.array_join(texts, " ")
        cue = F.struct(acc["cue"]["start"].alias("start"), acc["cue"]["end"].alias("end"), body.alias("body"))
        return F.when((body != "") & acc["cue"]["start"].isNotNull(), F.concat(acc["done"], F.array(cue))).otherwise(acc["done"])

    def time(x: Column) -> Column:
        return F.coalesce(timestamp_ms(x), F.lit(0).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        aside = (x == "") | (x == "WEBVTT") | x.rlike("^(" + "|".join(ASIDES) + ")")
        some = F.size(acc["cue"]["text"]) > 0
        fresh = F.struct(time(F.regexp_extract(x, r"^\s*(\S+)\s*-->", 1)).alias("start"), time(F.regexp_extract(x, r"-->\s*(\S+)", 1)).alias("end"), F.array().cast("array<string>").alias("text"))
        longer = F.struct(acc["cue"]["start"].alias("start"), acc["cue"]["end"].alias("end"), F.concat(acc["cue"]["text"], F.array(x)).alias("text"))
        return (
            F.when(aside & some, F.struct(closed(acc).alias("done"), line.alias("cue")))
            .when(aside, acc)
            .when(F.contains(x, F.lit("-->")), F.struct(F.when(some, closed(acc)).otherwise(acc["done"]).alias("done"), fresh.alias("cue")))
            .when(acc["cue"]["start"].isNotNull(), F.struct(acc["done"].alias("done"), longer.alias("cue")))
            .otherwise(acc)
        )

    lines = F.transform(F.split("content", r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^[\x{FEFF} ]+|[\x{FEFF} ]+$", ""))
    cues = F.aggregate(lines, begin, step, closed)
    rows = files.select("file", F.posexplode(cues).alias("n", "c"))
    return rows.select("file", (F.col("n") + 1).alias("idx"), F.col("c.start").alias("start_ms"), F.col("c.end").alias("end_ms"), unescape(F.col("c.body")).alias("body"))


def clipped(cues: DataFrame, key: str, order: str = "idx") -> DataFrame:
    """Cues that end where the next begins at the latest."""
    return cues.withColumn("end_ms", F.expr(f"least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY {key} ORDER BY {order}), end_ms))"))


def json_captions(files: DataFrame) -> DataFrame:
    """(file, idx, start_ms, end_ms, body, word_ms) of JSON caption files (file, content).

    Events that append, without segments or with times that are no numbers go, as do
    blank and music pieces; word_ms is the first word's start.
    """
    parsed = files.select("file", F.from_json("content", _CUES).alias("j")).select("file", F.posexplode("j.events").alias("n", "e"))
    rows = parsed.where("e.segs IS NOT NULL AND coalesce(e.aAppend, 0) = 0 AND e.tStartMs IS NOT NULL AND e.dDurationMs IS NOT NULL")
    real = F.filter("e.segs", lambda s: ~F.coalesce(F.trim(F.regexp_replace(s["utf8"], r"\s+", " ")), F.lit("")).isin("", "[Music]"))
    body = F.trim(F.regexp_replace(F.array_join(F.transform(real, lambda s: s["utf8"]), ""), r"\s+", " "))
    start = F.col("e.tStartMs").cast("long")
    rows = rows.select(
        "file",
        F.col("n").alias("idx"),
        start.alias("start_ms"),
        (F.col("e.tStartMs") + F.col("e.dDurationMs")).cast("long").alias("end_ms"),
        body.alias("body"),
        (F.col("e.tStartMs") + F.coalesce(F.get(real, F.lit(0))["tOffsetMs"], F.lit(0.0))).cast("long").alias("word_ms"),
    ).where("body <> ''")
    return clipped(rows, "file")


def recogniser_chunks(files: DataFrame) -> DataFrame:
    """(file, idx, start_ms, end_ms, body) of chunked recogniser output (file, content): ends are the next starts."""
    kind = "array<struct<text:string,metadata:struct<start:string>>>"
    rows = files.select("file", F.posexplode(F.from_json("content", kind)).alias("idx", "c"))
    rows = rows.select("file", "idx", mmss_to_ms(F.col("c.metadata.start"), F.col("idx")).alias("start_ms"), F.trim("c.text").alias("body")).where("body <> ''")
    return rows.withColumn("end_ms", F.expr("lead(start_ms) OVER (PARTITION BY file ORDER BY idx)"))


def slices(page: Column, size: int = 1000, seconds: int = 60) -> Column:
    """array<struct<start_ms, body>> of an HTML transcript: fixed slices of its text, a minute each."""

    def cut(body: Column) -> Column:
        count = F.ceil(F.length(body) / size).cast("int")
        parts = F.transform(
            F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
            lambda i: F.struct((i * seconds * 1000).alias("start_ms"), F.substring(body, i * size + 1, F.lit(size)).alias("body")),
        )
        return F.filter(parts, lambda s: s["body"] != "")

    return F.transform(F.array(clean_html_flat(page)), cut)[0]


def clean_lines(text: Column, boilerplate: list[str]) -> Column:
    """Lines with white space collapsed, without those that match a boilerplate pattern."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    keep = F.filter(lines, lambda x: (x != "") & ~F.coalesce(x.rlike("|".join(f"(?:{p})" for p in boilerplate) or r"(?!)"), F.lit(False)))
    return F.array_join(keep, "\n")
