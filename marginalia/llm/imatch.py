"""I-Match document fingerprints with randomised lexicon subsets, in DataFrame functions only.

The lexicon keeps the terms whose share of documents lies in a band, that is, whose
inverse document frequency does.  Its size is at most (mean distinct terms of a document)
/ (lower share), whatever the corpus size; it is counted before it is broadcast, and
joined by shuffle beyond LEXICON_ROWS.  The fingerprint has one 64-bit hash of the
document's sorted distinct terms for the whole lexicon and one for each of several
subsets of it, drawn at random and independently of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, parallelism

#: Shares of documents between which a term is in the lexicon.
BAND = (0.002, 0.2)

#: How many random subsets, and one term in how many each of them holds.
SUBSETS = ((20, 64), (11, 256))

#: Lexicon entries (16 bytes each) up to which it is broadcast.
LEXICON_ROWS = 1_000_000

#: The mark of a subset without terms.
NONE = "-" * 16


def terms(text: Column) -> Column:
    """Hashes of the distinct words (runs of letters and digits, lower-cased)."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> tuple[DataFrame, int]:
    """(term) of all terms in the band, over all documents, and their number.

    A term must also be in two documents at least.
    """
    n = docs.count()
    seen = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = materialise(seen.where(F.col("df").between(max(2, band[0] * n), max(2, band[1] * n))).select("term"), "lexicon")
    return kept, kept.count()


def likeness(a: str, b: str) -> Column:
    """Equal subset hashes among the subsets with terms in either; 1 if neither has any."""
    used = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x <> '{NONE}' OR y <> '{NONE}'), z -> z))")
    same = F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y AND x <> '{NONE}'), z -> z))")
    return F.when(used > 0, same / used).otherwise(F.lit(1.0))


def subsets_of(term: str, subsets: tuple[tuple[int, int], ...] = SUBSETS) -> str:
    """SQL of the random subsets, 1 and up, that hold a term: those that its hash with their number falls to."""
    parts, first = [], 1
    for many, one_in in subsets:
        parts.append(f"filter(sequence({first}, {first + many - 1}), j -> pmod(xxhash64({term}, j), {one_in}) = 0)")
        first += many
    return f"concat({', '.join(parts)})"


def _hashes(terms_: str, members: str, many: int) -> Column:
    """Sixteen hex digits each: the hash of sorted terms, then of those of each subset, from structs (j, term) in order.

    One pass chains the terms' hashes within each subset.
    """
    whole = f"aggregate(sort_array({terms_}), cast(null AS bigint), (h, t) -> if(h IS NULL, xxhash64(t), xxhash64(h, t)))"
    done = "if(a.j < 0, a.made, concat(a.made, array(struct(a.j AS j, a.h AS h))))"
    chained = (
        f"aggregate({members}, named_struct('j', -1, 'h', 0L, 'made', cast(array() AS array<struct<j:int,h:bigint>>)),"
        " (a, x) -> if(x.j = a.j, named_struct('j', a.j, 'h', xxhash64(a.h, x.term), 'made', a.made),"
        f" named_struct('j', x.j, 'h', xxhash64(x.term), 'made', {done})), a -> map_from_entries({done}))"
    )
    each = f"transform(sequence(1, {many}), j -> try_element_at(m, j))"
    return F.expr(f"transform(transform(array({chained}), m -> concat(array({whole}), {each}))[0], h -> coalesce(lpad(lower(hex(h)), 16, '0'), '{NONE}'))")


def with_next(docs: DataFrame) -> DataFrame:
    """(block, at, copy, doc_id, body, next_body): every document beside the next by doc_id.

    Documents are dealt by ranges of doc_id, whose bounds come from a quantile sketch, so
    no task orders them all.  The first row of each block is copied, marked ``copy``, to
    the end of the block before; the first of all to the end of the last.  Null ids come
    last; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    many = min(4 * parallelism(spark), 4096)
    bounds = body.approxQuantile("doc_id", [i / many for i in range(1, many)], 0.25 / many) if many > 1 else []
    cuts = sorted({int(b) for b in bounds or []})
    steps = [1 << k for k in reversed(range(max(len(cuts), 1).bit_length()))]
    known = f"array({', '.join(f'{c}L' for c in cuts)})" if cuts else "array(cast(null as bigint))"
    find = (
        f"aggregate(array({', '.join(map(str, steps))}), 0, (p, s) ->"
        f" if(p + s <= {len(cuts)} AND try_element_at({known}, p + s) <= doc_id, p + s, p))"
    )
    body = body.withColumn("block", F.expr(f"if(doc_id IS NULL, {len(cuts) + 1}, {find})"))
    # the least row of each block: at most as many rows as there are blocks
    firsts = sorted(
        body.groupBy("block").agg(F.min("doc_id").alias("first"), F.min(F.when(F.col("doc_id").isNull(), F.xxhash64("body"))).alias("key")).collect(),
        key=lambda r: r.block,
    )
    if not firsts:
        return body.select("block", F.lit(0).alias("at"), F.lit(False).alias("copy"), "doc_id", "body", F.col("body").alias("next_body"))
    before = {r.block: firsts[i - 1].block for i, r in enumerate(firsts)}
    target = spark.createDataFrame([(r.block, r.first, r.key, before[r.block]) for r in firsts], "b int, f long, k long, target int")
    on = (F.col("block") == F.col("b")) & (
        (F.col("doc_id") == F.col("f")) | (F.col("doc_id").isNull() & F.col("f").isNull() & (F.xxhash64("body") == F.col("k")))
    )
    lead = body.join(F.broadcast(target), on).groupBy("target", "doc_id").agg(F.min("body").alias("body"))
    rows = body.withColumn("copy", F.lit(False)).unionByName(
        lead.select("doc_id", "body", F.col("target").alias("block"), F.lit(True).alias("copy"))
    )
    order = "PARTITION BY block ORDER BY copy, doc_id ASC NULLS LAST, body"
    return rows.select(
        "block",
        F.expr(f"row_number() OVER ({order})").alias("at"),
        "copy",
        "doc_id",
        "body",
        F.expr(f"coalesce(lead(body) OVER ({order}), '')").alias("next_body"),
    )


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, subsets: tuple[tuple[int, int], ...] = SUBSETS) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how near each comes.

    The edited text has its last quarter (n_chars // 4 code points) replaced by as many of
    the next document's first ones, by ascending doc_id, the first after the last.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  A text without terms of the lexicon is printed by all its terms, so only
    texts without terms (null, empty, no letters or digits) have the empty fingerprint.
    Equal texts have equal fingerprints.  Repeated rows are kept, extra columns ignored;
    an empty table gives an empty result.
    """
    known, size = lexicon(docs, band)
    rows = with_next(docs)
    rows = rows.withColumn("n_chars", F.length("body").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(body, 1, n_chars - n_chars div 4), substring(next_body, 1, n_chars div 4))"))
    both = rows.select(
        "block", "at", "copy", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        terms(F.col("body")).alias("own"), terms(F.col("edited")).alias("new"),
    )
    # side 0 stands for the row itself and alone carries its columns; 1 are terms of the text
    # only, 2 of the edited one only, 3 of both
    row = "named_struct('copy', copy, 'doc_id', doc_id, 'n_chars', n_chars, 'edited_sha256', edited_sha256, 'own', own, 'new', new)"
    parts = {1: "array_except(own, new)", 2: "array_except(new, own)", 3: "array_intersect(own, new)"}
    sided = [f"transform({part}, t -> struct(t AS term, {side} AS side, if(false, {row}, null) AS row))" for side, part in parts.items()]
    each = both.select("block", "at", F.explode(F.expr(f"concat(array(struct(xxhash64(block, at) AS term, 0 AS side, {row} AS row)), {', '.join(sided)})")).alias("x"))
    each = each.select("block", "at", "x.*")
    marked = known.withColumn("js", F.expr(subsets_of("term", subsets)))
    if size <= LEXICON_ROWS:
        marked = F.broadcast(marked)
    each = each.join(marked, "term", "left").where("side = 0 OR js IS NOT NULL")
    # most terms are in no random subset: they come as bare numbers
    member = F.when(F.size("js") > 0, F.struct("js", "term"))
    sets = each.groupBy("block", "at").agg(
        F.max("row").alias("row"),
        *[F.collect_list(F.when(F.col("side").isin(*sides), F.col("term"))).alias(name) for name, sides in (("own", (1, 3)), ("new", (2, 3)))],
        *[F.collect_list(F.when(F.col("side").isin(*sides), member)).alias(f"{name}_in") for name, sides in (("own", (1, 3)), ("new", (2, 3)))],
    )
    many = sum(n for n, _ in subsets)
    made = sets
    for side, out in (("own", "print"), ("new", "edited_print")):
        # without a term of the lexicon all terms count
        alone = f"size({side}) = 0"
        inside = f"if({alone}, transform(row.{side}, t -> struct({subsets_of('t', subsets)} AS js, t AS term)), {side}_in)"
        made = made.withColumn("used", F.expr(f"if({alone}, row.{side}, {side})"))
        made = made.withColumn("members", F.expr(f"sort_array(flatten(transform({inside}, x -> transform(x.js, j -> struct(j AS j, x.term AS term)))))"))
        made = made.withColumn(out, _hashes("used", "members", many)).drop("used", "members")
    made = made.select("block", "at", "row.copy", "row.doc_id", "row.n_chars", "row.edited_sha256", "print", "edited_print")
    made = made.withColumn("next_print", F.expr("lead(print) OVER (PARTITION BY block ORDER BY at)")).where("NOT copy")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("print", "").alias("fingerprint"),
        F.array_join("edited_print", "").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"),
        likeness("print", "next_print").alias("near_next"),
    )
