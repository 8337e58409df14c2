"""A bit table of keys, broadcast, that tells most rows without a partner before anything is shuffled.

The table has at most BITS bits, whatever the number of keys, so what is collected and
broadcast is bounded.  A row whose bits are not both set has no partner; one whose bits
are set may have one, and a join decides.  With more keys than the table serves well, more
rows go on to the join; results do not change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, small_batches

#: Bits of a table at most (16 MB), and bits for each key as long as that is enough.
BITS, EACH = 1 << 27, 16


def _places(h: Column, size: int) -> list[Column]:
    return [h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1))]


def key_filter(keys: DataFrame, hashed: Column) -> Callable[[np.ndarray], np.ndarray]:
    """A function that tells, for an array of 64-bit hashes, which may be among those of ``keys``."""
    size = 1 << min(max((EACH * keys.count()).bit_length(), 16), BITS.bit_length() - 1)
    at = keys.select(hashed.alias("h")).select(F.explode(F.array(*_places(F.col("h"), size))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits"))
    found = words.toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    held = keys.sparkSession.sparkContext.broadcast(table)

    def may_hold(h: np.ndarray) -> np.ndarray:
        bits, low = held.value, np.uint64(len(held.value) * 64 - 1)
        h = h.view(np.uint64)
        out = np.ones(len(h), bool)
        for place in (h & low, h >> np.uint64(32) & low):
            out &= bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) == 1
        return out

    return may_hold


def parted(rows: DataFrame, may_hold: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """The rows that may have a partner and those that have none, by their column ``h``, which no row lacks."""
    small_batches(rows.sparkSession)
    at = rows.columns.index("h")

    def part(want: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may_hold(batch.column(at).to_numpy()) == want))

        return rows.mapInArrow(lean(run), rows.schema)

    return part(True), part(False)
