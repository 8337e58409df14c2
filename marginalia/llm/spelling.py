"""Spelling variants: words one edit apart, found in a positional q-gram index under a count filter.

Two words of lengths m <= n that differ by one inserted, deleted or replaced code point share
at least n - 5 of their 3-grams, at places that differ by one at most.

1. One edit lies in one third of the longer word, so near words share all grams of the other
   two.  A word is dealt to six buckets: by what each third leaves, once for its own
   length and once for a partner longer by one.
2. In a bucket, words of length n look up their 3-grams in an inverted index of the words
   before them, under limits of place and length.  The shortest posting lists, of which one must
   hold whatever meets the bound, are merged on a heap; what they hold is looked up in the
   longer ones until the bound is met or out of reach.
3. What meets the bound is compared code point by code point.  Words that share more than one
   such part would meet again; a pair counts where the later third is left out.

No bucket is split further: its words differ in one third of few code points, and
the index, not the number of its pairs, decides what a frequent ending costs.
"""

from __future__ import annotations

import heapq
import string
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, materialise, parallelism, small_batches

#: Code points of a gram; words shorter than 7 would share too few of them for the filter.
Q, SHORTEST = 3, 7

#: Runs that are words, from SHORTEST code points on.
_RUNS = r"[A-Za-zÀ-ÿ]{%d,}" % SHORTEST


def vocabulary(docs: DataFrame, every: int | None = None, least: int = 2) -> DataFrame:
    """(word, n): the words of all texts with their number of occurrences, ``least`` or more.

    A word is a maximal run of Latin letters with A-Z lower-cased, of at least SHORTEST code
    points.  With ``every``, runs whose unsigned crc32 of "doc_id:run" it divides lose the code
    point at that number modulo their length first (a fixed source of misspellings; a null
    doc_id counts as empty).  Null and empty texts have no words.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(_RUNS), F.lit(0))).alias("run"))
    rows = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    if every is not None:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word"))).withColumn("at", (F.col("h") % F.length("word")).cast("int"))
        cut = F.concat(F.substring("word", F.lit(1), F.col("at")), F.expr("substring(word, at + 2)"))
        rows = rows.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= SHORTEST)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def merged(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """(member, how many lists hold it) of sorted lists, by a merge on a heap."""
    for member, run in groupby(heapq.merge(*lists) if len(lists) > 1 else lists[0]):
        yield member, sum(1 for _ in run)


def near_in_bucket(words: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Positions of the pairs one edit apart whose longer word has ``size`` code points, in a list ordered by length.

    Two indexes hold the words so far of ``size`` and of ``size`` - 1 code points: in the
    first a shared gram has the same place, in the second the same or the one before.
    """
    same: dict[tuple[str, int], list[int]] = {}
    shorter: dict[tuple[str, int], list[int]] = {}
    bound = size - 2 * Q + 1
    for i, word in enumerate(words):
        grams = [(word[at : at + Q], at) for at in range(len(word) - Q + 1)]
        into = shorter
        if len(word) == size:
            into = same
            found = [p for g in grams if (p := same.get(g))]
            if shorter:
                found += [p for gram, at in grams for place in (at, at - 1) if (p := shorter.get((gram, place)))]
            # what shares ``bound`` grams is in ``bound`` of these lists, so in one of the shortest of them
            if len(found) >= bound:
                found.sort(key=len)
                few = len(found) - bound + 1
                for member, many in merged(found[:few]):
                    left = bound - 1
                    for longer in found[few:]:
                        if many >= bound or many + left < bound:
                            break
                        at = bisect_left(longer, member)
                        many += at < len(longer) and longer[at] == member
                        left -= 1
                    if many >= bound and one_edit(words[member], word):
                        yield member, i
        for g in grams:
            held = into.get(g)
            if held is None:
                into[g] = [i]
            else:
                held.append(i)


def _thirds(size: int) -> tuple[int, int]:
    return size // 3, size - size // 3


def _met(key: str, rows: list[tuple[str, int]]) -> Iterator[tuple]:
    """The pairs of one bucket; ``key`` is the length of the longer word, the third that is left out, and the rest."""
    rows.sort(key=lambda r: (len(r[0]), r[0]))
    size = len(rows[-1][0])
    if not key.startswith(f"{size}"):  # no word here is the longer one
        return
    third = key[len(f"{size}")]
    one, two = _thirds(size)
    for i, j in near_in_bucket([r[0] for r in rows], size):
        a, b = rows[i][0], rows[j][0]
        before = third != "c" and a[:two] == b[:two] or third == "a" and a[:one] == b[:one] and a[two - size :] == b[two - size :]
        if not before:
            yield *rows[i], *rows[j]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, word, n) ordered by key -> pairs of near words, bucket by bucket."""
    key, rows, out = None, [], []
    for batch in batches:
        for k, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if len(rows) > 1:
                    out += _met(key, rows)
                key, rows = k, []
            rows.append((word, n))
        if len(out) >= 4096:
            yield _batch(out)
            out = []
    if len(rows) > 1:
        out += _met(key, rows)
    yield _batch(out)


_PAIRS = "a string, a_n long, b string, b_n long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["a", "a_n", "b", "b_n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words once, of ``words`` (word, n; distinct words).

    Words of fewer than SHORTEST code points are an error: the filter would not be exact.
    """
    small_batches(words.sparkSession)
    if not words.where(F.length("word") < SHORTEST).isEmpty():
        raise ValueError(f"words have at least {SHORTEST} code points")

    def keys(size: str) -> str:
        one, two = f"({size}) div 3", f"{size} - ({size}) div 3"
        rests = {"c": f"left(word, {two})", "b": f"left(word, {one}), '-', right(word, {one})", "a": f"right(word, {two})"}
        return ", ".join(f"concat({size}, '{third}', {rest})" for third, rest in rests.items())

    keys = F.expr(f"array({keys('length(word)')}, {keys('length(word) + 1')})")
    dealt = words.select(F.explode(keys).alias("key"), "word", "n").repartition(parallelism(words.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lean(_meet), _PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): where following forms ends.

    Forms must not lead in a circle.  Each round doubles the steps, so a path of d steps takes log2(d) rounds.
    """
    found = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(found.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").isEmpty():
            return step.drop("moved")
        found = step.drop("moved")


def variant_groups(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``words`` (word, n) with form, root, n_near and form_n.

    n_near counts the near words; the form is the near word of largest n, the first in
    code-point order of several, if that n is at least ``ratio`` times the word's own; form_n is
    its n.  The root is where forms lead to in the end, the word itself without a form.  ``ratio`` is
    2 at least, so that forms never lead in a circle (else ValueError).  Equal words count together.  An
    empty table gives an empty one.
    """
    if ratio < 2:
        raise ValueError("ratio is at least 2")
    words = materialise(words.groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    met = near_pairs(words)
    # each pair serves both of its words: one pass over the pairs
    sides = met.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("n")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near"))).alias("best"))
    told = words.join(best, "word", "left")
    fits = -F.col("best.less") >= F.col("n") * ratio
    told = materialise(
        told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "spelling-told"
    )
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
