"""Training-order materialisation: every token sequence gets a global slot, and shards hold slots in order.

Sequences are numbered 0..n-1; a Feistel network keyed by the caller permutes a domain
of the next power of four, and walking its cycle until the value falls below n makes it
a permutation of the numbers themselves.  No shuffle table exists: a slot is computed,
and inverted, in constant memory.  Range partitions by slot then write shards with one
fixed stride, so a reader finds any slot by arithmetic and resumes anywhere.

A sequence is up to ``length`` bytes of one text; its record is their number (two bytes,
little-endian), then the bytes, then zeros up to the stride.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checked_broadcast, materialise, parallelism, small_batches
from .keyfilter import key_filter, parted
from .textvec import flat, mix

_U = np.uint64

#: Rounds of the network.
ROUNDS = 4

#: Bytes of a sequence, and slots of a shard.
LENGTH, SHARD_SLOTS = 512, 8192


def _half_bits(n: int) -> int:
    return max((max(n - 1, 1).bit_length() + 1) // 2, 1)


def _keys(key: int) -> list[np.uint64]:
    raw = hashlib.blake2b(str(key).encode(), digest_size=8 * ROUNDS).digest()
    return [_U(int.from_bytes(raw[8 * i : 8 * i + 8], "little")) for i in range(ROUNDS)]


def _network(x: np.ndarray, bits: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    low = _U((1 << bits) - 1)
    left, right = x >> _U(bits), x & low
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (mix(left + k) & low), left
        else:
            left, right = right, left ^ (mix(right + k) & low)
    return left << _U(bits) | right


def permute(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The slots of the indices below n, or with ``back`` the indices of the slots."""
    out = np.asarray(index).astype(_U)
    if len(out) and int(out.max()) >= n:
        raise ValueError("an index beyond the sequences")
    bits, keys = _half_bits(n), _keys(key)
    with np.errstate(over="ignore"):
        out = _network(out, bits, keys, back)
        while True:  # more than a quarter of the domain is below n, so few steps remain
            beyond = np.flatnonzero(out >= _U(n))
            if not len(beyond):
                return out.astype(np.int64)
            out[beyond] = _network(out[beyond], bits, keys, back)


def stride_of(length: int) -> int:
    """Bytes of a record."""
    if not 0 < length < 1 << 16:
        raise ValueError("a sequence has 1 to 65535 bytes")
    return length + 2


def numbered(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, int]:
    """(doc_id, text_hash, many, copies, first) of every distinct row, and the count of all sequences.

    A row has ``many`` sequences, one at least; rows equal in doc_id and text (``copies``)
    have theirs one after another from ``first`` on.  Rows are ordered by (doc_id with nulls
    first, text hash); ranges of them are summed in parallel and only one count a range comes
    to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.greatest(F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / F.lit(length)), F.lit(1)).cast("long").alias("many"),
    )
    rows = rows.groupBy("doc_id", "text_hash").agg(F.max("many").alias("many"), F.count("*").alias("copies"))
    dealt = rows.repartitionByRange(parallelism(spark), "doc_id", "text_hash").withColumn("range", F.spark_partition_id())
    dealt = materialise(dealt, "slots")
    sums = sorted((r.range, r.n) for r in dealt.groupBy("range").agg(F.sum(F.col("many") * F.col("copies")).alias("n")).collect())
    base, at = [], 0
    for part, n in sums:
        base.append((part, at))
        at += n
    starts = spark.createDataFrame(base or [(0, 0)], "range int, base long")
    order = "PARTITION BY range ORDER BY doc_id, text_hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    with_start = dealt.withColumn("own", F.expr(f"sum(many * copies) OVER ({order}) - many * copies"))
    # one row for each range, as many as there are partitions
    out = with_start.join(F.broadcast(starts), "range").select("doc_id", "text_hash", "many", "copies", (F.col("base") + F.col("own")).alias("first"))
    return materialise(out, "slots"), at


def assign_slots(docs: DataFrame, key: int = 1, length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, int]:
    """The sequences of all texts with slot, shard, offset (bytes within the shard) and record, and their number.

    A null or empty text is one sequence without bytes (n_tokens 0).  Rows equal in doc_id and
    text each have sequences of their own.  Texts are not shuffled but where a row is
    repeated, or where there are more rows than a broadcast of their numbers may have.
    """
    numbers, n = numbered(docs, length)
    small_batches(docs.sparkSession)
    stride = stride_of(length)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.col("text").alias("body"))
    body = body.withColumn("h", F.xxhash64("doc_id", "hash"))
    again = materialise(numbers.where("copies > 1").select("doc_id", "text_hash"), "slots-again")
    if not again.isEmpty():
        # one row of each repeated one stands for all of its copies
        near, rest = parted(body, key_filter(again, F.xxhash64("doc_id", "text_hash")))
        body = rest.unionByName(near.groupBy("doc_id", "hash", "h").agg(F.min("body").alias("body")))
    held = numbers.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "many", "copies", "first")
    joined = body.join(checked_broadcast(held), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("t")))
    rows = joined.select("doc_id", "body", F.explode(F.expr("sequence(first, first + (copies - 1) * many, many)")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat(batch.column(1))
            size = np.diff(off)
            many = np.maximum(-(-size // length), 1)
            start = np.concatenate([[0], np.cumsum(many)])
            doc = np.repeat(np.arange(len(size)), many)
            part = np.arange(len(doc)) - start[doc]
            used = np.minimum(np.maximum(size[doc] - part * length, 0), length)
            grid = np.zeros((len(doc), stride), np.uint8)
            grid[:, 0], grid[:, 1] = used & 255, used >> 8
            at = np.arange(len(data)) - np.repeat(off[:-1], size)
            grid[np.repeat(start[:-1], size) + at // length, 2 + at % length] = data
            slot = permute(batch.column(2).to_numpy(zero_copy_only=False)[doc] + part, n, key)
            ends = pa.array(np.arange(len(doc) + 1) * stride, pa.int64())
            records = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, ends.buffers()[1], pa.py_buffer(grid.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(part), pa.array(slot), pa.array(slot // shard_slots), pa.array(slot % shard_slots * stride), pa.array(used), records],
                names=["doc_id", "part", "slot", "shard", "offset", "n_tokens", "record"],
            )

    return rows.mapInArrow(run, "doc_id long, part long, slot long, shard long, offset long, n_tokens long, record binary"), n


def _name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


#: Bytes of records that a task gathers before it packs them by shard.
PACK_BYTES = 16 << 20


def _packed(shard_slots: int):
    """(shard, slot, record) -> (shard, places, blob): a task's records for one shard together, compressed."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        shard = np.concatenate([b.column(0).to_numpy() for b in held])
        place = (np.concatenate([b.column(1).to_numpy() for b in held]) % shard_slots).astype("<i4")
        records = np.array([r for b in held for r in b.column(2).to_pylist()], object)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        parts = [order[x:y] for x, y in zip(cuts, [*cuts[1:], len(order)])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(shard[p[0]]) for p in parts], pa.int64()),
                pa.array([place[p].tobytes() for p in parts], pa.binary()),
                pa.array([zlib.compress(b"".join(records[p]), 1) for p in parts], pa.binary()),
            ],
            names=["shard", "places", "blob"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def write_shards(sequences: DataFrame, path: str, n: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> None:
    """Write the ``n`` ``sequences`` (shard, slot, record) as shard-NNNNNN.bin files into ``path`` (any file system that pyarrow knows).

    Shards are dealt to tasks by ranges, records packed; a task puts one shard at a time
    together (shard_slots records) and writes it in slot order under a name of its own
    attempt, renamed at the end: a lost task leaves no half shard, and a rerun writes the
    same bytes.
    """
    from pyarrow import fs

    stride = stride_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        shard, grid, most = None, np.zeros((0, stride), np.uint8), 0

        def close() -> None:
            if shard is not None:
                temp = f"{root}/.{_name(shard)}-{uuid.uuid4().hex}"
                with store.open_output_stream(temp) as out:
                    out.write(grid[:most].tobytes())
                store.move(temp, f"{root}/{_name(shard)}")

        for batch in batches:
            for at, places, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if at != shard:
                    close()
                    shard, grid, most = at, np.zeros((shard_slots, stride), np.uint8), 0
                where = np.frombuffer(places, "<i4")
                grid[where] = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(-1, stride)
                most = max(most, int(where.max()) + 1)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], names=["done"])

    shards = max(-(-n // shard_slots), 1)
    tasks = min(parallelism(sequences.sparkSession), shards)
    packed = sequences.select("shard", "slot", "record").mapInArrow(_packed(shard_slots), "shard long, places binary, blob binary")
    dealt = packed.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} AS int)")).sortWithinPartitions("shard")
    dealt.mapInArrow(run, "done long").count()


def read_slots(path: str, first: int, count: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> Iterator[bytes]:
    """The bytes of the sequences from slot ``first`` on, by one seek and sequential reads; ends behind the last slot."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    stride = stride_of(length)
    while count > 0:
        shard, within = divmod(first, shard_slots)
        name = f"{root}/{_name(shard)}"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            return
        with store.open_input_file(name) as f:
            f.seek(min(within * stride, f.size()))
            here = min(count, shard_slots - within)
            raw = f.read(here * stride)
        for at in range(0, len(raw), stride):
            used = int.from_bytes(raw[at : at + 2], "little")
            yield raw[at + 2 : at + 2 + used]
        got = len(raw) // stride
        first, count = first + got, count - got if got == here else 0


def shard_rows(spark: SparkSession, path: str, n: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(slot, shard, offset, n_tokens, ids_sha256) of the ``n`` slots, read back from the shards, a shard a task."""
    shards = max(-(-n // shard_slots), 1) if n else 0
    stride = stride_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                held = list(read_slots(path, shard * shard_slots, shard_slots, length, shard_slots))
                at = np.arange(len(held))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at + shard * shard_slots), pa.array(np.full(len(held), shard)), pa.array(at * stride),
                        pa.array([len(x) for x in held], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in held], pa.string()),
                    ],
                    names=["slot", "shard", "offset", "n_tokens", "ids_sha256"],
                )

    tasks = max(min(shards, parallelism(spark)), 1)
    return spark.range(0, shards, 1, tasks).mapInArrow(run, "slot long, shard long, offset long, n_tokens long, ids_sha256 string")
