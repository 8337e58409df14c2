"""Conversation repair: the cheapest edits to a lawful order of roles, by shortest paths with small integer costs.

A lawful conversation has role initials ``(s?(ua)+)?``.  Its rows are kept (0), given the
other role (3), deleted (4) or have an empty row put before them (3); a row that is cut off costs 3
more if it stays; blank rows and repeats must go.  So a conversation is a graph: a layer for
each row, four nodes in a layer (at the start, after s, after u, after a).  Dial's bucket queue
gives every node's distance to the end, and a walk along tight arcs, the least letter first,
gives the edits (D, I, K, R).

Rows that must go are no choice: they cost 4 wherever they stand, and D is the least letter,
so they are counted beside the graph.  Rows are laid out by range of (conversation, turn) and cut into
blocks of at most ``BLOCK`` rows.  A conversation inside one block is solved there.  Of others, each
block gives the 4 x 4 distances between its ends; these few numbers a block are chained
backwards to the distances at the block ends, all blocks are walked from each of
the four nodes at once, and a pass over the blocks picks the walks that join.  So no task
holds a whole conversation, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, materialise, parallelism, small_batches

#: Rows of one block.
BLOCK = 4096

#: What edits cost.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3

#: Nodes of a layer; codes of role initials are 0 (s), 1 (u), 2 (a) and 3 (others).
START, AFTER_S, AFTER_U, AFTER_A = range(4)

#: Where a role's initial leads from a node, by code; None: nowhere.
_NEXT = ((AFTER_S, AFTER_U, None, None), (None, AFTER_U, None, None), (None, None, AFTER_A, None), (None, AFTER_U, None, None))

#: Where a user's or an assistant's row leads: from each node one of the two is lawful.
_FLIP = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
_FLIP_ROLE = ("user", "user", "assistant", "user")

_FAR = 1 << 60

#: Distances to the end from the nodes after the last row.
ENDS = [0, _FAR, _FAR, 0]

_SPACE = " \t\n\x0b\x0c\r"


def distances(codes: bytes, ends: list[int]) -> list[list[int]]:
    """Distance from every node to the end, by layer: Dial's algorithm against the arcs.

    ``codes`` has a byte a row, the code of its initial and 4 more if it is cut off;
    ``ends`` has the distances from the nodes after the last row.
    """
    rows = len(codes)
    dist = [[_FAR] * 4 for _ in range(rows + 1)]
    reached = [e for e in ends if e < _FAR]
    if not reached:
        return dist
    base = min(reached)
    # distances in the queue span the ends' spread and the dearest arc
    ring = max(reached) - base + max(DELETE, INSERT, REROLE + CUT) + 1
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(ring)]
    waiting = 0
    for node, e in enumerate(ends):
        if e < _FAR:
            dist[rows][node] = e - base
            buckets[(e - base) % ring].append((rows, node))
            waiting += 1
    near = 0
    while waiting:
        bucket = buckets[near % ring]
        while bucket:
            layer, node = bucket.pop()
            waiting -= 1
            if dist[layer][node] != near:
                continue
            arcs = [(layer, before, INSERT) for before in range(4) if _FLIP[before] == node]
            if layer:
                code = codes[layer - 1]
                stay = CUT if code & 4 else 0
                arcs.append((layer - 1, node, DELETE))
                arcs += [(layer - 1, before, stay) for before in range(4) if _NEXT[before][code & 3] == node]
                arcs += [(layer - 1, before, REROLE + stay) for before in range(4) if _FLIP[before] == node]
            for to, before, cost in arcs:
                if near + cost < dist[to][before]:
                    dist[to][before] = near + cost
                    buckets[(near + cost) % ring].append((to, before))
                    waiting += 1
        near += 1
    return [[d + base if d < _FAR else _FAR for d in layer] for layer in dist]


def walk(codes: bytes, gone: list[int], dist: list[list[int]], ends: list[int], node: int) -> tuple[str, int]:
    """The least of the cheapest edits from ``node`` before the first row, and the node after the last.

    ``gone`` counts the rows that must go before each row and after the last.
    """
    out = ["D" * gone[0]]
    layer, rows = 0, len(codes)
    while True:
        here = dist[layer][node]
        if layer == rows:
            if here == ends[node]:
                return "".join(out), node
            out.append("I")
            node = _FLIP[node]
            continue
        stay = CUT if codes[layer] & 4 else 0
        kept = _NEXT[node][codes[layer] & 3]
        if here == DELETE + dist[layer + 1][node]:
            letter = "D"
        elif here == INSERT + dist[layer][_FLIP[node]]:
            out.append("I")
            node = _FLIP[node]
            continue
        elif kept is not None and here == stay + dist[layer + 1][kept]:
            letter, node = "K", kept
        else:
            letter, node = "R", _FLIP[node]
        out.append(letter)
        layer += 1
        out.append("D" * gone[layer])


def replayed(codes: bytes, gone: list[int], audit: str, node: int) -> Iterator[tuple[int, list[str], str | None]]:
    """(row, roles put before it, its role) of the rows that stay or have rows before them: "" keeps the role, None deletes the row.

    The row after the last one, for what is put at the end, has the number of rows.
    """
    at, before = gone[0], []
    for row in range(len(codes) + 1):
        while at < len(audit) and audit[at] == "I":
            before.append(_FLIP_ROLE[node])
            node, at = _FLIP[node], at + 1
        role = None
        if row < len(codes):
            letter = audit[at]
            if letter == "K":
                role, node = "", _NEXT[node][codes[row] & 3]
            elif letter == "R":
                role, node = _FLIP_ROLE[node], _FLIP[node]
            at += 1 + gone[row + 1]
        if role is not None or before:
            yield row, before, role
            before = []


# rows, by DataFrames


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as a fixed rule damages them, with ``copies``; nulls are one space.

    The unsigned crc32 of "conv_id:turn" modulo 20 says how: 0 drops a row, 1 empties its text, 2
    removes ``.!?`` from it, 3 makes it two, 4 gives it the role user.
    """
    def told(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    how = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = told("text")
    return rows.where(how != 0).select(
        "conv_id", "turn", F.when(how == 4, F.lit("user")).otherwise(told("role")).alias("role"),
        F.when(how == 1, F.lit("")).when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(how == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def _seen(rows: DataFrame) -> DataFrame:
    """Rows with what decides: digest of role and text, code of the initial, blank, cut."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.coalesce(F.col("copies"), F.lit(1)).cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    bare = F.rtrim(text, F.lit(_SPACE))
    initial = F.substring(role, F.lit(1), F.lit(1))
    return rows.select(
        "conv_id", F.col("turn").isNotNull().alias("has"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("code"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    ).where("copies > 0")


_BLOCK_COLUMNS = (
    "part int, seq int, whole boolean, codes binary, gone array<long>, digests array<string>, first int, last int, "
    "blank long, duplicate long, truncated long, illegal long, lengths array<long>, entry int, audit string, cost long"
)

#: Codes of neighbours that are lawful: su, ua, au.
_LAWFUL = {(0, 1), (1, 2), (2, 1)}


def _block(rows: list[tuple]) -> dict:
    """What a run of one conversation's rows (code, blank, known, cut, copies, digest) comes to."""
    codes, gone, digests, blank, duplicate, illegal = bytearray(), [0], [], 0, 0, 0
    for i, (code, is_blank, known, cut, copies, digest) in enumerate(rows):
        illegal += copies - 1 + (i > 0 and (rows[i - 1][0], code) not in _LAWFUL)
        if is_blank:
            blank += copies
            gone[-1] += copies
        elif known:
            duplicate += copies
            gone[-1] += copies
        else:
            codes.append(code | (4 if cut else 0))
            digests.append(digest)
            duplicate += copies - 1
            gone.append(copies - 1)
    return {
        "codes": bytes(codes), "gone": gone, "digests": digests, "first": rows[0][0], "last": rows[-1][0],
        "blank": blank, "duplicate": duplicate, "truncated": sum(c >> 2 for c in codes), "illegal": illegal,
    }


def _solved(block: dict, whole: bool) -> dict:
    """A whole conversation's edits, or the distances through a part of one: from each node before it to each after it."""
    codes, gone = block["codes"], block["gone"]
    if whole:
        dist = distances(codes, ENDS)
        audit, _ = walk(codes, gone, dist, ENDS, START)
        return {"lengths": None, "entry": START, "audit": audit, "cost": dist[0][START] + DELETE * sum(gone)}
    to = [distances(codes, [0 if e == node else _FAR for e in range(4)])[0] for node in range(4)]
    return {"lengths": [to[b][a] for a in range(4) for b in range(4)], "entry": None, "audit": None, "cost": None}


def _blocks(kind: pa.DataType, block: int):
    """Rows in order -> blocks; a conversation at an edge of the partition may go on beyond it."""
    names = [c.split()[0] for c in _BLOCK_COLUMNS.split(", ")]
    types = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "long": pa.int64(), "string": pa.string()}
    kinds = [types[c.split()[1]] for c in _BLOCK_COLUMNS.split(", ")]

    def made(out: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array([k for k, _ in out], kind), *(pa.array([b[n] for _, b in out], t) for n, t in zip(names, kinds))]
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, held, key, edge = TaskContext.get().partitionId(), 0, [], [], None, True

        def closed(whole: bool) -> None:
            nonlocal seq, held
            b = _block(held)
            out.append((key, {**b, **_solved(b, whole), "part": part, "seq": seq, "whole": whole}))
            seq, held = seq + 1, []

        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and conv != key:
                    closed(not edge)
                    edge = False
                elif len(held) == block:
                    edge = True
                    closed(False)
                key = conv
                held.append(tuple(row))
            if len(out) >= 256:
                yield made(out)
                out = []
        if held:
            closed(False)
        yield made(out)

    return run


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, part, seq, lengths), last block first -> distances to the end at each block's end."""
    key, ends = None, None
    for batch in batches:
        found = []
        for conv, lengths in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if ends is None or conv != key:
                key, ends = conv, ENDS
            found.append(ends)
            ends = [min(min(lengths[4 * a + b] + ends[b] for b in range(4)), _FAR) for a in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "part", "seq", "ends"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, part, seq, codes, gone, ends) -> the edits, the node after and the distance, from each of the four nodes before."""
    for batch in batches:
        found: list[tuple] = []
        for codes, gone, ends in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
            dist = distances(codes, ends)
            found.append(tuple(zip(*(walk(codes, gone, dist, ends, node) if dist[0][node] < _FAR else ("", node) for node in range(4)))) + (dist[0],))
        cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["conv_id", "part", "seq", "audits", "after", "far"])


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order with their walks -> the walk that the conversation takes, what meets at block edges, its cost at the first block."""
    key, node, last, fresh = None, START, None, True
    for batch in batches:
        rows = []
        for conv, audits, after, far, first, final in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7))):
            begins = fresh or conv != key
            if begins:
                key, node, fresh = conv, START, False
            rows.append((node, audits[node], far[node] if begins else 0, int(not begins and (last, first) not in _LAWFUL)))
            node, last = after[node], final
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["conv_id", "part", "seq", "entry", "audit", "far", "met"])


def _chained(blocks: DataFrame) -> DataFrame:
    """The blocks of conversations that lie in several, or may, with entry, audit and cost."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    n = parallelism(blocks.sparkSession)
    split = blocks.where("NOT whole")
    at = ["conv_id", "part", "seq"]
    back = split.select(*at, "lengths").repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    ends = materialise(back.mapInArrow(_backwards, f"conv_id {kind}, part int, seq int, ends array<long>"), "repair-ends")
    # part and seq name a block
    walked = split.select(*at, "codes", "gone").join(ends.select("part", "seq", "ends"), ["part", "seq"]).select(*at, "codes", "gone", "ends")
    walked = walked.mapInArrow(lean(_walks), f"conv_id {kind}, part int, seq int, audits array<string>, after array<int>, far array<long>")
    edges = split.select("part", "seq", F.col("first").alias("one"), F.col("last").alias("other"))
    ahead = walked.join(edges, ["part", "seq"]).select(*at, "audits", "after", "far", "one", "other").repartition(n, "conv_id").sortWithinPartitions(*at)
    taken = ahead.mapInArrow(_forwards, f"conv_id {kind}, part int, seq int, entry int, audit string, far long, met long")
    rest = split.drop("entry", "audit", "cost", "lengths").withColumnRenamed("illegal", "within")
    both = rest.join(taken.drop("conv_id"), ["part", "seq"])
    cost = F.col("far") + DELETE * F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x)
    return both.withColumn("illegal", F.col("within") + F.col("met")).withColumn("cost", cost).drop("within", "far", "met")


def _lines(kind: pa.DataType):
    """Blocks -> the rows of the repaired conversation, with the roles put before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, seq, codes, gone, digests, audit, entry in zip(*(c.to_pylist() for c in batch.columns)):
                for row, before, role in replayed(codes, gone, audit, entry):
                    out.append((conv, part, seq, row, before, None if role is None else digests[row], role))
            kinds = (kind, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string())
            names = ["conv_id", "part", "seq", "row", "before", "digest", "role"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def _digests(kind: pa.DataType):
    """(conv_id, line), in order -> the SHA-256 of each conversation's lines joined by newlines, fed line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or conv != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "sha"])
            out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "sha"])

    return run


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Summary and lines of the repaired conversations of ``rows`` (conv_id, turn, role, text, and copies if it has them).

    Rows count in order of turn, nulls first; of one turn, by a digest of role and text, equal
    ones side by side.  Null roles and texts are one space, null conv_ids are one conversation.  The summary has
    one row a conversation: conv_id, blank, duplicate, truncated, illegal, cost (longs) and audit.
    Lines (conv_id, part, seq, row, line) are those of the repaired conversation, ``role:text``, ordered
    by their numbers; rows that are put in have no text.  Other columns are left out.  An empty table gives
    empty ones.
    """
    spark = rows.sparkSession
    small_batches(spark)
    seen = _seen(rows)
    # the first row of each role and text: those that may stay, with their texts
    told = seen.where("NOT blank").groupBy("conv_id", "digest", "role", "text").agg(F.min(F.struct("has", "turn")).alias("first"))
    told = materialise(told, "repair-texts")
    slim = seen.groupBy("conv_id", "has", "turn", "digest", "code", "blank", "cut").agg(F.sum("copies").alias("copies"))
    firsts = told.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first.turn").alias("t"), F.lit(True).alias("stays"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    known = F.coalesce(F.col("stays") & ~F.col("turn").eqNullSafe(F.col("t")), F.lit(False))
    slim = slim.join(firsts, same, "left").select("conv_id", "has", "turn", "digest", "code", "blank", known.alias("known"), "cut", "copies")
    order = ["conv_id", "has", "turn", "digest"]
    laid = slim.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order).select("conv_id", "code", "blank", "known", "cut", "copies", "digest")
    field = laid.schema["conv_id"]
    kind = pa.string() if field.dataType.simpleString() == "string" else pa.int64() if field.dataType.simpleString() == "bigint" else pa.int32()
    blocks = materialise(laid.mapInArrow(lean(_blocks(kind, block)), f"conv_id {field.dataType.simpleString()}, {_BLOCK_COLUMNS}"), "repair-blocks")
    done = blocks.where("whole").drop("lengths").unionByName(_chained(blocks))
    done = materialise(done, "repair-solved")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "")
    summary = done.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], audit.alias("audit"))
    steps = done.select("conv_id", "part", "seq", "codes", "gone", "digests", "audit", "entry").mapInArrow(
        lean(_lines(kind)), f"conv_id {field.dataType.simpleString()}, part int, seq int, row int, before array<string>, digest string, role string"
    )
    texts = told.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("role").alias("own"), "text")
    own = F.when(F.col("role").isNotNull(), F.concat(F.when(F.col("role") == "", F.col("own")).otherwise(F.col("role")), F.lit(":"), F.col("text")))
    put = F.transform("before", lambda r: F.concat(r, F.lit(":")))
    lines = steps.join(texts, same, "left").select("conv_id", "part", "seq", "row", F.posexplode(F.filter(F.concat(put, F.array(own)), lambda x: x.isNotNull())).alias("nth", "line"))
    return summary, lines


def line_digests(lines: DataFrame) -> DataFrame:
    """(conv_id, sha): SHA-256 of each conversation's lines joined by newlines.

    One digest is one pass over its bytes, so a conversation's lines stream through one task, which holds a batch.
    """
    kind = lines.schema["conv_id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    order = ["conv_id", "part", "seq", "row", "nth"]
    dealt = lines.repartition(parallelism(lines.sparkSession), "conv_id").sortWithinPartitions(*order).select("conv_id", "line")
    return dealt.mapInArrow(lean(_digests(arrow)), f"conv_id {kind}, sha string")


def gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turns missing between a conversation's least and greatest, 0 without turns (2**63 - 1 at most)."""
    each = rows.select("conv_id", F.col("turn").cast("long").alias("turn")).distinct()
    most = F.lit(2**63 - 1).cast("decimal(20,0)")
    wide = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn")
    return each.groupBy("conv_id").agg(F.when(wide > most, most).otherwise(F.coalesce(wide, F.lit(0))).cast("long").alias("gaps"))
