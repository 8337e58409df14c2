"""A keyword and vector index that grows and shrinks by parts, with filters as bitmaps.

Documents get dense ordinals; ``WINDOW`` of them in a row are a window, and all tables go by window:

* ``postings``: one row a token and window, a posting block: a bitmap of the documents that hold
  the token, their counts and lengths, and what bounds any score in the block;
* ``bitmaps``: one row a value of tenant, language, tree or entity and window;
* ``lengths``, ``docs`` and ``vectors``: the documents themselves.

An append writes one segment of new windows, a delete the bitmap of what is gone; neither touches what is
there.  Segments of like size are merged, ``FAN`` at a time, so a document is rewritten a
logarithmic number of times.  A state row names the segments; readers see a change whole or
not at all, and an open index reads only the segments that it does not hold yet.

A search finds the windows that can hold one of the best: the sum of block bounds against the
least score that the most promising windows show to be needed.  Blocks of other windows are not
read.  Filters are ands of bitmaps, so document frequencies under any filter are bit counts.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize, tokens_of
from ..runtime import BROADCAST_ROWS, materialise, parallelism
from .index import TTL, unit

#: Documents of a window; a block's bitmap is one long.
WINDOW = 64

#: Segments of like size that are merged into one.
FAN = 8

#: Buckets of a large segment's postings, one folder each, and documents for each bucket of a smaller one.
BUCKETS, BUCKET_DOCS = 64, 20_000

#: Windows scored first, to learn what score is needed, and windows that the driver looks at, at most.
SEEDS, PEEK = 8, 65_536

#: Blocks of a query that are read without looking for what can be left out: a few MB.
DIRECT = 10_000

#: Windows named in a filter; more are joined.
NAMED = 1_000

#: Windows that are written to one file of a bucket.
_STRETCH = 8_192

K1, B = 1.2, 0.75

FIELDS = ("tenant", "language", "tree", "entity")

_SCHEMAS = {
    "postings": "token string, window long, bits long, peak double, entries array<struct<pos:int,tf:int,dl:int>>, bucket int",
    "bitmaps": "field string, value string, window long, bits long",
    "lengths": "window long, bits long, lengths array<struct<pos:int,dl:int>>",
    "docs": "ord long, window long, doc_id {kind}, dl int, title string, weight double, tenant string, language string, tree string, entities array<string>",
    "vectors": "ord long, window long, unit array<double>",
}


@dataclass(frozen=True)
class Pruned:
    """How a search goes: its windows (None: all of them, or those in ``more``), the score needed, how
    many blocks the query's tokens have and how many are read, the tokens' inverse frequencies, the mean length."""

    windows: list[int] | None
    needed: float
    blocks: int
    read: int
    worth: dict[str, float]
    mean: float
    more: DataFrame | None = None


def _marked() -> Column:
    """The bitmap of the places ``pos`` in a group."""
    return F.expr("bit_or(shiftleft(1L, pos))").alias("bits")


def _has(pos: Column, bits: Column) -> Column:
    return F.call_function("getbit", bits, pos) == 1


def _pos() -> Column:
    return F.pmod("ord", F.lit(WINDOW)).cast("int")


def _part(tf: Column, dl: Column, mean: float) -> Column:
    """A token's part of a score over its inverse frequency."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(mean or 1.0))))


class BlockIndex:
    """An index in the folder ``path``; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = TTL, hold: bool = False, direct: int = DIRECT) -> None:
        self.spark, self.path, self.ttl, self.hold, self.direct = spark, path.rstrip("/"), ttl, hold, direct
        self.state: dict = {"version": 0, "kind": "bigint", "segments": [], "deleted": [], "next": 0, "n": 0, "total": 0}
        self.opened, self._open, self._sizes = -math.inf, {}, {}
        self.refresh(force=True)

    # state

    def _newest(self) -> dict | None:
        try:
            row = self.spark.read.schema("version long, state string").parquet(f"{self.path}/state/*").orderBy(F.desc("version")).first()
        except AnalysisException:  # no state yet
            return None
        return json.loads(row.state) if row else None

    def refresh(self, force: bool = False) -> bool:
        """Look for a newer version once the time to live has passed; was there one?

        Segments that are held stay open; only new ones are opened, and those that are gone let go.
        """
        if not force and time.monotonic() - self.opened < self.ttl:
            return False
        found, self.opened = self._newest(), time.monotonic()
        if found is None or found["version"] == self.state["version"]:
            return False
        self._take(found)
        return True

    def _take(self, state: dict) -> None:
        self.state, self._sizes = state, {}
        named = {s["id"] for s in state["segments"]}
        for gone in set(self._open) - named:
            tables = self._open.pop(gone)
            if self.hold:
                tables["vectors"].unpersist()
        for segment in named - set(self._open):
            tables = {name: self._read(name, segment) for name in _SCHEMAS}
            if self.hold:
                tables["vectors"] = tables["vectors"].cache()
            self._open[segment] = tables

    def _read(self, name: str, segment: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name].format(kind=self.state["kind"])).parquet(f"{self.path}/{name}/{segment}")

    def _commit(self, **changes) -> None:
        """The new state; a second writer of the same version fails, as its folder is there."""
        state = {**self.state, **changes, "version": self.state["version"] + 1}
        row = self.spark.createDataFrame([(state["version"], json.dumps(state))], "version long, state string")
        row.coalesce(1).write.parquet(f"{self.path}/state/{state['version']:012d}")
        self._take(state)
        self.opened = time.monotonic()

    def _table(self, name: str, segments: list[str] | None = None) -> DataFrame:
        held = [self._open[s["id"]][name] for s in self.state["segments"] if segments is None or s["id"] in segments]
        return reduce(DataFrame.unionByName, held) if held else self.spark.createDataFrame([], _SCHEMAS[name].format(kind=self.state["kind"]))

    # writing

    def append(self, docs: DataFrame) -> int:
        """Add ``docs`` (doc_id, text, and of title, weight, tenant, language, tree, entities and vector what there is); returns their number.

        A doc_id that is there already is there twice; ``replace`` takes the old one out.  Null
        texts have no tokens.  Weights of 0 or less are an error.
        """
        self.refresh(force=True)
        given = set(docs.columns)
        kinds = {"title": "string", "weight": "double", "tenant": "string", "language": "string", "tree": "string", "entities": "array<string>", "vector": "array<double>"}
        more = [(F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
        rows = docs.select("doc_id", F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("toks"), *more)
        weight = F.coalesce("weight", F.lit(1.0))
        rows = rows.withColumn("weight", F.when(weight > 0, weight).otherwise(F.raise_error(F.lit("a weight is positive")).cast("double")))
        rows = rows.withColumn("dl", F.size("toks")).withColumn("unit", unit(F.col("vector"))).drop("vector")
        # as one text, tokens take a fraction of an array's bytes in the two shuffles to come; no token holds a space
        rows = rows.withColumn("words", F.array_join("toks", " ")).drop("toks")
        kind = rows.schema["doc_id"].dataType.simpleString()
        if self.state["segments"] and kind != self.state["kind"]:
            raise ValueError(f"doc_id is {self.state['kind']} here")
        numbered, n, total = self._numbered(rows, self.state["next"])
        if not n:
            return 0
        each = numbered.where("dl > 0").select("window", "ord", "dl", "weight", F.explode(F.split("words", " ")).alias("token"))
        tokens = each.groupBy("window", "token", "ord", "dl", "weight").agg(F.count("*").cast("int").alias("tf"))
        segment = self._written(numbered.drop("words"), tokens, n, total)
        self._commit(kind=kind, segments=[*self.state["segments"], segment], next=segment["last"] + 1, n=self.state["n"] + n, total=self.state["total"] + total)
        self._merge_tiers()
        return n

    def _numbered(self, rows: DataFrame, first: int) -> tuple[DataFrame, int, int]:
        """``rows`` with dense ordinals from window ``first`` on, windows whole in a partition; their number and tokens.

        Documents of one tenant, language and length are neighbours: their blocks have like bounds, which
        is what lets a search leave blocks out.
        """
        order = ["tenant", "language", "dl"]
        laid = rows.repartitionByRange(parallelism(self.spark), *order).sortWithinPartitions(*order)
        held = materialise(laid.withColumn("at", F.monotonically_increasing_id()), "index-rows")
        part = F.shiftright("at", 33)
        # a row for each task that wrote
        sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).orderBy("part").collect()
        begins, upto = [], first * WINDOW
        for r in sizes:
            begins.append((r.part, upto))
            upto += r.n
        parts = F.broadcast(self.spark.createDataFrame(begins, "part long, begin long"))
        ords = held.join(parts, part == F.col("part")).withColumn("ord", F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1))
        numbered = ords.withColumn("window", F.floor(F.col("ord") / WINDOW).cast("long")).drop("at", "part", "begin")
        return numbered.repartition("window"), sum(r.n for r in sizes), sum(r.dl for r in sizes)

    def _written(self, docs: DataFrame, tokens: DataFrame, n: int, total: int) -> dict:
        """Write a segment of ``docs`` and ``tokens`` (window, token, ord, dl, weight, tf), both whole by window.

        A block's ``peak`` is the greatest part of a score in it, but for the token's own worth, at the
        segment's mean length.  At another mean no part grows by more than the means' ratio.
        """
        segment, ref = uuid.uuid4().hex, max(total / n, 1.0)
        buckets = min(BUCKETS, n // BUCKET_DOCS + 1)
        files = max(min(parallelism(self.spark), n // BUCKET_DOCS), 1)
        docs = materialise(docs, "index-docs")
        blocks = tokens.withColumn("pos", _pos()).groupBy("window", "token").agg(
            _marked(), F.max(F.col("weight") * _part(F.col("tf"), F.col("dl"), ref)).alias("peak"),
            F.sort_array(F.collect_list(F.struct("pos", "tf", "dl"))).alias("entries"),
        )
        blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        dealt = blocks.repartition(files, "bucket", F.floor(F.col("window") / _STRETCH)) if files > 1 else blocks.coalesce(1)
        dealt.sortWithinPartitions("bucket", "token", "window").write.partitionBy("bucket").parquet(f"{self.path}/postings/{segment}")
        own = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS[:3]])
        linked = F.transform(F.coalesce(F.array_distinct("entities"), F.array().cast("array<string>")), lambda e: F.struct(F.lit("entity").alias("field"), e.alias("value")))
        marks = docs.select("window", _pos().alias("pos"), F.explode(F.concat(own, linked)).alias("f")).groupBy("f.field", "f.value", "window").agg(_marked())
        lengths = docs.withColumn("pos", _pos()).groupBy("window").agg(_marked(), F.collect_list(F.struct("pos", "dl")).alias("lengths"))

        def put(rows: DataFrame, name: str, *order: str) -> None:
            laid = rows.repartitionByRange(files, *order) if files > 1 else rows.coalesce(1)
            laid.sortWithinPartitions(*order).write.parquet(f"{self.path}/{name}/{segment}")

        put(marks, "bitmaps", "field", "value", "window")
        put(lengths, "lengths", "window")
        put(docs.drop("unit"), "docs", "ord")
        put(docs.where("unit IS NOT NULL").select("ord", "window", "unit"), "vectors", "ord")
        ends = docs.agg(F.min("window").alias("first"), F.max("window").alias("last")).first()
        return {"id": segment, "first": ends["first"], "last": ends["last"], "docs": n, "buckets": buckets, "ref": ref}

    def delete(self, ids: DataFrame) -> int:
        """Take out the documents with a doc_id of ``ids``; returns how many there were."""
        self.refresh(force=True)
        hit = self._table("docs").select("doc_id", "ord", "window", "dl").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        hit = materialise(self._living(hit).select("window", _pos().alias("pos"), "dl"), "index-hit")
        row = hit.agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).first()
        if row.n:
            name = uuid.uuid4().hex
            hit.groupBy("window").agg(_marked()).coalesce(1).write.parquet(f"{self.path}/deleted/{name}")
            self._commit(deleted=[*self.state["deleted"], name], n=self.state["n"] - row.n, total=self.state["total"] - row.dl)
        return row.n

    def replace(self, docs: DataFrame) -> int:
        """Append ``docs`` and take out what had their doc_ids before."""
        self.delete(docs)
        return self.append(docs)

    def _dead(self) -> DataFrame:
        """(window, bits) of what is gone."""
        rows = self.spark.read.schema("window long, bits long").parquet(*[f"{self.path}/deleted/{d}" for d in self.state["deleted"]])
        return rows.groupBy("window").agg(F.bit_or("bits").alias("bits"))

    def _living(self, rows: DataFrame) -> DataFrame:
        """``rows`` (ord, window) of documents that are not gone."""
        if not self.state["deleted"]:
            return rows
        dead = self._dead().select(F.col("window").alias("w"), F.col("bits").alias("gone"))
        return rows.join(dead, F.col("window") == F.col("w"), "left").where(~F.coalesce(_has(_pos(), F.col("gone")), F.lit(False))).drop("w", "gone")

    def _merge_tiers(self) -> None:
        while True:
            tiers: dict[int, list[str]] = {}
            for s in self.state["segments"]:
                tiers.setdefault(int(math.log(max(s["docs"], 1), FAN)), []).append(s["id"])
            full = [ids for ids in tiers.values() if len(ids) >= FAN]
            if not full:
                return
            self.merge(full[0])

    def merge(self, segments: list[str] | None = None) -> None:
        """Make one segment of several (of all, if none are named), without what is gone."""
        ids = segments or [s["id"] for s in self.state["segments"]]
        merged = [s for s in self.state["segments"] if s["id"] in ids]
        rest = [s for s in self.state["segments"] if s["id"] not in ids]
        docs = self._table("docs", ids).join(self._table("vectors", ids).select("ord", "unit"), "ord", "left")
        dead, names = None, self.state["deleted"]
        if names:
            dead = self._dead()
            docs = self._living(docs)
        numbered, n, total = self._numbered(docs.withColumnRenamed("ord", "old").drop("window"), self.state["next"])
        if dead is not None:
            within = reduce(lambda a, b: a | b, [F.col("window").between(s["first"], s["last"]) for s in merged])
            left = materialise(dead.where(~within), "index-dead")
            names = []
            if not left.isEmpty():
                names = [uuid.uuid4().hex]
                left.coalesce(1).write.parquet(f"{self.path}/deleted/{names[0]}")
        if n:
            numbered = materialise(numbered, "index-numbered")
            # the new ordinal of every old one, window by window
            news = numbered.groupBy(F.floor(F.col("old") / WINDOW).cast("long").alias("window")).agg(
                F.map_from_entries(F.collect_list(F.struct(F.pmod("old", F.lit(WINDOW)).cast("int"), F.struct("ord", "weight")))).alias("news")
            )
            each = self._table("postings", ids).join(news, "window").select("token", "news", F.explode("entries").alias("e"))
            each = each.select("token", F.element_at("news", F.col("e.pos")).alias("new"), F.col("e.tf").alias("tf"), F.col("e.dl").alias("dl")).where("new IS NOT NULL")
            tokens = each.select(F.floor(F.col("new.ord") / WINDOW).cast("long").alias("window"), "token", "new.ord", "dl", "new.weight", "tf")
            segment = self._written(numbered.drop("old"), tokens, n, total)
            self._commit(segments=[*rest, segment], deleted=names, next=segment["last"] + 1)
        else:
            self._commit(segments=rest, deleted=names)

    # reading

    def _allowed(self, filters: dict[str, list]) -> DataFrame | None:
        """(window, fits): bitmaps of the documents that pass all filters and are not gone; None if that is all."""
        found = None
        for field, values in filters.items():
            if field not in FIELDS:
                raise ValueError(f"filters are on {', '.join(FIELDS)}")
            named = [v for v in values if v is not None]
            fits = F.col("value").isin(named) if named else F.lit(False)
            rows = self._table("bitmaps").where((F.col("field") == field) & (fits | F.col("value").isNull() if None in values else fits))
            rows = rows.groupBy("window").agg(F.bit_or("bits").alias("fits"))
            found = rows if found is None else found.join(rows.withColumnRenamed("fits", "more"), "window").select("window", F.col("fits").bitwiseAND(F.col("more")).alias("fits"))
        if self.state["deleted"]:
            base = self._table("lengths").select("window", F.col("bits").alias("fits")) if found is None else found
            gone = F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))
            found = base.join(self._dead(), "window", "left").select("window", F.col("fits").bitwiseAND(gone).alias("fits"))
        return None if found is None else found.where("fits <> 0")

    def _within(self, rows: DataFrame, keep: DataFrame | None) -> DataFrame:
        """``rows`` of windows with documents that pass, and ``fits``; as many numbers as there are windows go out, if they are few."""
        if keep is None:
            return rows.withColumn("fits", F.lit(-1).cast("long"))
        return rows.join(F.broadcast(keep) if self.state["next"] <= BROADCAST_ROWS else keep, "window")

    def _valued(self, rows: DataFrame, worth: dict[str, float]) -> DataFrame:
        """``rows`` with the ``value`` of their token: a table of as many rows as a query has tokens."""
        return rows.join(F.broadcast(self.spark.createDataFrame(list(worth.items()), "token string, value double")), "token")

    def _of(self, tokens: list[str], windows: list[int] | None = None) -> DataFrame:
        """Posting blocks of the tokens: folders and row groups of others are not read."""
        held = []
        for s in self.state["segments"]:
            own = [w for w in windows if s["first"] <= w <= s["last"]] if windows is not None else None
            if own == []:
                continue
            buckets = [F.pmod(F.xxhash64(F.lit(t)), F.lit(s["buckets"])).cast("int") for t in tokens]
            rows = self._open[s["id"]]["postings"].where(F.col("bucket").isin(*buckets) & F.col("token").isin(*tokens)).withColumn("ref", F.lit(s["ref"]))
            held.append(rows if own is None else self._windowed(rows, own))
        return reduce(DataFrame.unionByName, held) if held else self.spark.createDataFrame([], _SCHEMAS["postings"] + ", ref double")

    def _windowed(self, rows: DataFrame, windows: list[int]) -> DataFrame:
        if len(windows) <= NAMED:
            return rows.where(F.col("window").isin(*windows))
        # PEEK numbers at most
        return rows.join(F.broadcast(self.spark.createDataFrame([(w,) for w in windows], "window long")), "window", "left_semi")

    def size(self, filters: dict[str, list] | None = None) -> tuple[int, int]:
        """Documents that pass and their tokens; counted once a version."""
        if not filters:
            return self.state["n"], self.state["total"]
        key = json.dumps(filters, sort_keys=True)
        if key not in self._sizes:
            rows = self._within(self._table("lengths").drop("bits"), self._allowed(filters))
            rows = rows.select(F.filter("lengths", lambda x: _has(x["pos"], F.col("fits"))).alias("l"))
            row = rows.agg(F.sum(F.size("l")).alias("n"), F.sum(F.expr("aggregate(l, 0L, (a, x) -> a + x.dl)")).alias("total")).first()
            self._sizes[key] = (row.n or 0, row.total or 0)
        return self._sizes[key]

    def _idf(self, df: int, n: int, formula: str, times: int) -> float:
        if formula == "fts":
            return max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * times
        return max(0.0, math.log(1 + (n - df + 0.5) / (df + 0.5)))

    def plan(self, query: str, limit: int = 10, filters: dict[str, list] | None = None, scope: str = "filtered", formula: str = "scan") -> Pruned:
        """What a search reads, found by a few small aggregates over the blocks' heads.

        Windows whose bounds do not reach the score needed are out, so a frequent token's blocks are read
        where it meets a rare one or weighs much by itself.
        """
        times = Counter(tokens_of(query))
        tokens = list(times)
        n, total = self.size(filters if scope == "filtered" else None)
        mean = total / n if n else 1.0
        keep = self._allowed(filters or {})

        def heads(keep: DataFrame | None) -> DataFrame:
            rows = self._within(self._of(tokens).drop("entries", "bucket"), keep)
            rows = rows.withColumn("bits", F.col("bits").bitwiseAND(F.col("fits"))).where("bits <> 0")
            return rows.select("token", "window", "bits", (F.col("peak") * F.greatest(F.lit(1.0), F.lit(float(mean)) / F.col("ref"))).alias("part"))

        own = heads(keep)
        # as many rows as the query has tokens
        sums = [F.sum(F.bit_count("bits")).alias("df"), F.count("*").alias("blocks")]
        seen = {r.token: r for r in own.groupBy("token").agg(*sums).collect()}
        df = {t: r.df for t, r in seen.items()}
        if filters and scope == "global":
            df = {r.token: r.df for r in heads(self._allowed({})).groupBy("token").agg(sums[0]).collect()}
        worth = {t: self._idf(df[t], n, formula, times[t]) for t in seen}
        blocks = sum(r.blocks for r in seen.values())
        if not worth:
            return Pruned([], 0.0, 0, 0, worth, mean)
        if blocks <= self.direct:
            return Pruned(None, 0.0, blocks, blocks, worth, mean)
        bounds = self._valued(own, worth).groupBy("window").agg(F.sum(F.col("value") * F.col("part")).alias("bound"), F.count("*").alias("blocks"))
        top = bounds.orderBy(F.desc("bound"), "window").limit(PEEK).collect()
        if len(top) <= SEEDS:
            return Pruned([r.window for r in top], 0.0, blocks, blocks, worth, mean)
        seeds = self._scored(worth, mean, keep, [r.window for r in top[:SEEDS]]).orderBy(F.desc("score")).limit(limit).select("score").collect()
        needed = seeds[-1].score if len(seeds) == limit else 0.0
        # equal scores stay, whatever their last digits
        least = needed - 1e-8
        live = {r.window: r.blocks for r in top if r.bound >= least}
        if len(live) == PEEK:
            return Pruned(None, needed, blocks, blocks, worth, mean, bounds.where(F.col("bound") >= least).select("window"))
        read = sum(r.blocks for r in top[:SEEDS] if r.window not in live) + sum(live.values())
        return Pruned(list(live), needed, blocks, read, worth, mean)

    def _scored(self, worth: dict[str, float], mean: float, keep: DataFrame | None, windows: list[int] | DataFrame | None) -> DataFrame:
        """(ord, doc_id, title, score) of the documents in some windows, or in all."""
        docs = self._table("docs").select("ord", "window", "doc_id", "title", "weight")
        if windows is None:
            blocks = self._of(list(worth)).select("token", "window", "entries")
        elif isinstance(windows, DataFrame):
            blocks = self._of(list(worth)).select("token", "window", "entries").join(windows, "window", "left_semi")
            docs = docs.join(windows, "window", "left_semi")
        else:
            blocks = self._of(list(worth), windows).select("token", "window", "entries")
            docs = self._windowed(docs, windows)
            docs = F.broadcast(docs) if len(windows) * WINDOW <= BROADCAST_ROWS else docs
        each = self._within(blocks, keep).select("token", "window", "fits", F.explode("entries").alias("e"))
        if keep is not None:
            each = each.where(_has(F.col("e.pos"), F.col("fits")))
        part = F.col("value") * _part(F.col("e.tf"), F.col("e.dl"), mean)
        summed = self._valued(each, worth).groupBy((F.col("window") * WINDOW + F.col("e.pos")).alias("ord")).agg(F.sum(part).alias("score"))
        return summed.join(docs.drop("window"), "ord").select("ord", "doc_id", "title", (F.col("score") * F.col("weight")).alias("score"))

    def search(self, query: str, limit: int = 10, filters: dict[str, list] | None = None, scope: str = "filtered", formula: str = "scan") -> DataFrame:
        """(doc_id, score) of the best documents for a query.

        ``filters`` map tenant, language, tree or entity to the values that pass (None: those without
        one); a document passes all of them.  Statistics are those of what passes, or with scope ``global`` of
        all documents.  The formulas are those of ``KeywordIndex``.  Ties go by title, then by doc_id.  A query without
        tokens has no rows.
        """
        if scope not in ("global", "filtered") or formula not in ("scan", "fts"):
            raise ValueError("scope is global or filtered, formula is scan or fts")
        self.refresh()
        empty = self.spark.createDataFrame([], f"doc_id {self.state['kind']}, score double")
        if not tokens_of(query) or not self.state["segments"]:
            return empty
        found = self.plan(query, limit, filters, scope, formula)
        if not found.worth or found.windows == []:
            return empty
        rows = self._scored(found.worth, found.mean, self._allowed(filters or {}), found.more if found.windows is None else found.windows)
        return rows.where("score > 0").orderBy(F.desc(F.round("score", 9)), "title", "doc_id").limit(limit).select("doc_id", "score")

    def nearest(self, query: list[float], limit: int = 10, filters: dict[str, list] | None = None) -> DataFrame:
        """(doc_id, score) by cosine times weight, above 0, of documents with a vector of the query's width.

        A zero query has no rows.  Filters as in ``search``.
        """
        self.refresh()
        norm = float(np.linalg.norm(query)) if len(query) else 0.0
        if norm == 0.0 or not self.state["segments"]:
            return self.spark.createDataFrame([], f"doc_id {self.state['kind']}, score double")
        asked = ", ".join(f"{float(x) / norm!r}D" for x in query)
        rows = self._table("vectors").where(F.size("unit") == len(query))
        keep = self._allowed(filters or {})
        if keep is not None:
            rows = self._within(rows, keep).where(_has(_pos(), F.col("fits")))
        rows = rows.select("ord", F.expr(f"aggregate(zip_with(unit, array({asked}), (x, y) -> x * y), 0D, (a, b) -> a + b)").alias("near")).where("near > 0")
        docs = self._table("docs").select("ord", "doc_id", "weight")
        scored = rows.join(docs, "ord").select("doc_id", (F.col("near") * F.col("weight")).alias("score"))
        return scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(limit)

    def holds(self) -> DataFrame:
        """(doc_id): the documents that are in the index."""
        rows = self._table("docs").select("doc_id", "ord", "window")
        keep = self._allowed({})
        if keep is None:
            return rows.select("doc_id")
        return self._within(rows, keep).where(_has(_pos(), F.col("fits"))).select("doc_id")
