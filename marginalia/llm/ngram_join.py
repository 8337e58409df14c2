"""N-gram Jaccard self-join by prefix trees, reduced to its classes.

The n-gram sets of similar documents meet in one task, which stores them, in one
global order, in a path-compressed trie and walks it with each set: all sets below a
node share the overlap counted so far, and a subtree is left as soon as the overlap
plus what can remain of either set falls short of the threshold.

Which sets meet is exact as well.  A set of n n-grams can only link if at least
ceil(n num/den) of them are in another set too, so

1. n-grams whose hash lies in a fixed range are counted first; a set goes if too many of
   its own are nowhere else;
2. over the sets that are left, all n-grams are counted, and each set's are ordered by
   (frequency, hash).  Two sets that link share one of their first
   n - ceil(n num/den) + 1; those that more than one set holds are posted;
3. sets that meet at a posted n-gram form candidate classes.  A class whose n-grams fit
   one task is joined there.  A larger one is dealt into blocks, the blocks' classes
   into blocks by one set of each, and what then still meets across classes at a posted
   n-gram meets by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checked_broadcast, lean, materialise, parallelism, small_batches
from .graph import components
from .keyfilter import key_filter, parted
from .textvec import blocks, flat, shingle_sets

_U = np.uint64

#: N-grams (8 bytes each) that one task joins at once.
TASK_SHINGLES = 500_000


class Trie:
    """Path-compressed prefix tree of sorted rank arrays, with length bounds at every node."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        token, rank, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # rare n-grams first: sets that are not alike part at once
        order = np.empty(len(token), np.int64)
        order[np.lexsort((token, count))] = np.arange(len(token))
        ranks = order[rank]
        ends = np.cumsum([len(s) for s in sets])
        self.sets = [np.sort(r) for r in np.split(ranks, ends[:-1])]
        self.mark = np.zeros(len(token), bool)
        by = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        # how many sets share a set's n-grams, on average
        self.central = np.array([count[r].mean() for r in np.split(rank, ends[:-1])])
        # node: depth from, depth to, a set whose path it is, least and greatest length, inner
        # children, sets that end here, leaf children
        self.root = [0, 0, by[0], 0, 0, [], [], None]
        path = [self.root]
        last: np.ndarray | None = None
        for i in by:
            s = self.sets[i]
            shared = 0
            if last is not None:
                k = min(len(last), len(s))
                differ = np.flatnonzero(last[:k] != s[:k])
                shared = int(differ[0]) if len(differ) else k
            while path[-1][0] >= shared and len(path) > 1:
                path.pop()
            node = path[-1]
            if node[1] > shared:  # split the edge where the paths part
                low = [shared, node[1], node[2], 0, 0, node[5], node[6], None]
                node[1], node[5], node[6] = shared, [low], []
            if len(s) == node[1]:
                node[6].append(i)
            else:
                leaf = [node[1], len(s), i, 0, 0, [], [i], None]
                node[5].append(leaf)
                path.append(leaf)
            last = s
        stack, nodes = [self.root], []
        while stack:
            node = stack.pop()
            nodes.append(node)
            stack += node[5]
        for node in reversed(nodes):
            lengths = [len(self.sets[i]) for i in node[6]]
            node[3] = min(lengths + [c[3] for c in node[5]])
            node[4] = max(lengths + [c[4] for c in node[5]])
        for node in nodes:
            node[5], node[7] = self._bundle(node[5])

    def _bundle(self, children: list) -> tuple[list, tuple | None]:
        """The inner children, and the leaves among them laid end to end so that one look-up scores all."""
        leaves = [c for c in children if not c[5]]
        if not leaves:
            return children, None
        edges = [self.sets[c[2]][c[0] : c[1]] for c in leaves]
        begin = np.concatenate([[0], np.cumsum([len(e) for e in edges])[:-1]])
        ends = np.repeat(np.arange(len(leaves)), [len(c[6]) for c in leaves])
        ids = np.array([i for c in leaves for i in c[6]])
        lengths = np.array([c[1] for c in leaves])
        inner = [c for c in children if c[5]]
        return inner, (np.concatenate(edges), begin, ends, ids, lengths, int(lengths.min()), int(lengths.max()))

    def similar(self, x: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sets, overlaps, unions) of all sets with overlap/union >= num/den, by one walk."""
        own = self.sets[x]
        size = len(own)
        self.mark[own] = True
        found: list[tuple] = []

        def short(matched: int, left: int, least: int, most: int) -> bool:
            """Does what is left of either set fall short of the least overlap that any length below allows?"""
            return matched + min(left, most) < -(-num * (size + max(least, 1)) // (num + den))

        stack = [(self.root, 0)]
        while stack:
            node, matched = stack.pop()
            low, depth = node[0], node[1]
            left = size
            if depth > low:
                seg = self.sets[node[2]][low:depth]
                matched += int(np.count_nonzero(self.mark[seg]))
                left -= int(np.searchsorted(own, seg[-1], "right"))
            if short(matched, left, node[3], node[4] - depth):
                continue
            if node[6]:
                union = size + depth - matched
                if den * matched >= num * union:
                    found.append((np.array(node[6]), np.full(len(node[6]), matched), np.full(len(node[6]), union)))
            if node[7] is not None:
                edges, begin, ends, ids, lengths, least, most = node[7]
                if not short(matched, left, least, most - depth):
                    overlap = matched + np.add.reduceat(self.mark[edges], begin, dtype=np.int64)
                    union = size + lengths - overlap
                    ok = (den * overlap >= num * union)[ends]
                    found.append((ids[ok], overlap[ends[ok]], union[ends[ok]]))
            stack += [(child, matched) for child in node[5]]
        self.mark[own] = False
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(f) for f in zip(*found))


def link_classes(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """The class of every set under links of Jaccard >= num/den: the index of its first member.

    Sets are walked from the most central on, those whose n-grams most others share.  A
    set that links to a walked one need not be walked itself: its links to walked sets
    are known, and Jaccard distance is a metric, so a link to another such set b puts b
    within the link distance of the walked set's farthest such member.  Those b in
    other classes are found by the same walk, at twice the link distance, and walked in the end.
    """
    n = len(sets)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    if n == 1:
        return [0]
    trie = Trie(sets)
    wide, limit = max(2 * num - den, 0), 1 - num / den
    reached, walked = np.zeros(n, bool), np.zeros(n, bool)
    around: list[tuple[int, np.ndarray]] = []

    def walk(i: int, keep: bool) -> None:
        walked[i] = True
        ids, overlap, union = trie.similar(i, wide if keep else num, den)
        linked = den * overlap >= num * union
        for j in ids[linked].tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if keep:
            far = 1 - overlap / union
            new = linked & ~reached[ids] & ~walked[ids]
            if new.any():
                near = ids[~linked & (far <= limit + far[new].max() + 1e-9)]
                around.append((i, near))
            reached[ids[linked]] = True

    for i in np.argsort(-trie.central, kind="stable").tolist():
        if not reached[i] and not walked[i]:
            walk(i, True)
    for i, near in around:
        for j in near[~walked[near]].tolist():
            if not walked[j] and root(j) != root(i):
                walk(j, False)
    return [root(i) for i in range(n)]


_SETS = "doc_id long, text_hash long, n_shingles long, node binary, ref long"


def _sets_of(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes | None]]]:
    """For each block of a batch: its rows from and to, the sets end to end, n+1 offsets, and 96-bit names."""
    data, off = flat(batch.column(column))
    for i, j in blocks(off):
        sets, cut = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
        raw = memoryview(sets.view(np.uint8))
        names = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b])[:12] if b > a else None for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        yield i, j, sets, cut, names


def _ref(names: list[bytes | None]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] if x else bytes(8) for x in names), np.int64)


def _set_rows(size: int):
    """(doc_id, text_hash, text) -> the name and size of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, j, _, cut, names in _sets_of(batch, 2, size):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(i, j - i),
                            batch.column(1).slice(i, j - i),
                            pa.array(np.diff(cut), pa.int64()),
                            pa.array(names, pa.binary()),
                            pa.array(_ref(names)),
                        ],
                        names=["doc_id", "text_hash", "n_shingles", "node", "ref"],
                    )

    return run


def _range_rows(size: int, bound: int):
    """(text) -> (token, ref) for the n-grams with a hash below ``bound``; a block's equal sets count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for _, _, sets, cut, names in _sets_of(batch, 0, size):
                    fresh = np.zeros(len(names), bool)
                    fresh[list({x: k for k, x in enumerate(names) if x}.values())] = True
                    lengths = np.diff(cut)
                    keep = np.repeat(fresh, lengths) & (sets <= _U(bound))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sets[keep].view(np.int64)), pa.array(np.repeat(_ref(names), lengths)[keep])], names=["token", "ref"]
                    )

    return run


def _token_rows(size: int, may_hold: Callable[[np.ndarray], np.ndarray]):
    """(doc_id, text_hash, text, h) -> (doc_id, text_hash, tokens), the sets of the rows that may be asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                batch = whole.filter(pa.array(may_hold(whole.column(3).to_numpy())))
                for i, j, sets, cut, _ in _sets_of(batch, 2, size):
                    tokens = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(sets.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), tokens], names=["doc_id", "text_hash", "tokens"])

    return run


def _solve_rows(num: int, den: int):
    """Batches (task, id, tokens) sorted by task -> (a, b) edges, a star for each class found in one task."""

    def solve(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        label = link_classes(sets, num, den)
        pairs = [(nodes[c], nodes[k]) for k, c in enumerate(label) if c != k]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, sets = None, [], []
        for batch in batches:
            lists = batch.column(2)
            off, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(_U)
            for k, (task, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if task != held:
                    if len(nodes) > 1:
                        yield solve(nodes, sets)
                    held, nodes, sets = task, [], []
                nodes.append(node)
                sets.append(values[off[k] : off[k + 1]].copy())
        if len(nodes) > 1:
            yield solve(nodes, sets)

    return run


def _solved(members: DataFrame, num: int, den: int) -> DataFrame:
    """Verified edges among ``members`` (task, id, tokens) that share a task."""
    dealt = members.select("task", "id", "tokens").repartition(parallelism(members.sparkSession), "task").sortWithinPartitions("task")
    return materialise(dealt.mapInArrow(lean(_solve_rows(num, den)), "a long, b long"), "ngram-links")


def _stars(posts: DataFrame) -> DataFrame:
    """Edges (a, b) from the least id at every token to the others there."""
    least = posts.groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").drop("z")
    return posts.join(least, "token").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def _weighed(members: DataFrame, by: str) -> DataFrame:
    """``members`` (with n) and ``total``, the n-grams of all that share ``by``."""
    return members.join(members.groupBy(by).agg(F.sum("n").alias("total")), by)


def _block(many: Column) -> Column:
    return F.pmod(F.xxhash64("id"), F.greatest(many, F.lit(1)))


def _classes(edges: DataFrame, tag: str) -> DataFrame:
    return components(edges, tag).withColumnRenamed("node", "id")


def _links(alive: DataFrame, posts: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """(id, root) of all sets that link with another; root stands for the class.

    ``alive`` has id, n and tokens, ``posts`` token and id.
    """
    near = _classes(_stars(posts), "ngram-near")
    sized = materialise(_weighed(alive.select("id", "n").join(near, "id"), "root"), "ngram-near")
    members = alive.join(checked_broadcast(sized.select("id", "root", "total")), "id")
    edges = _solved(members.where(F.col("total") <= most).withColumn("task", F.col("root").cast("string")), num, den)
    large = sized.where(F.col("total") > most)
    if large.isEmpty():
        return _classes(edges, "ngram-classes")

    def dealt(rows: DataFrame) -> DataFrame:
        """One task for each random block of a class; near copies of one text unite here."""
        many = F.ceil(F.col("total") / F.lit(most))
        return alive.select("id", "tokens").join(checked_broadcast(rows.withColumn("task", F.concat_ws("/", "root", _block(many))).select("id", "task")), "id")

    edges = edges.union(_solved(dealt(large), num, den))
    united = _classes(edges, "ngram-part")
    heads = large.join(united.select("id", F.col("root").alias("head")), "id", "left").where("head IS NULL OR head = id").drop("total", "head")
    edges = edges.union(_solved(dealt(materialise(_weighed(heads, "root"), "ngram-heads")), num, den))
    united = _classes(edges, "ngram-part")
    # what still meets across classes is compared in full
    told = posts.join(large.select("id"), "id", "left_semi").join(united, "id", "left").select("token", "id", F.coalesce("root", "id").alias("class"))
    mixed = told.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("token")
    rest = _classes(_stars(told.join(mixed, "token", "left_semi").select("token", "id")), "ngram-rest")
    rest = _weighed(alive.select("id", "n").join(rest, "id"), "root")
    wide = F.when(F.col("total") <= most, F.lit(1)).otherwise(F.ceil(F.col("total") / F.lit(max(most // 2, 1))))
    rest = rest.withColumn("wide", wide).withColumn("block", _block(F.col("wide")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("wide") - 1),
        lambda k: F.concat_ws("/", "root", F.least(k, F.col("block")), F.greatest(k, F.col("block"))),
    )
    rest = materialise(rest.withColumn("task", F.explode(pairs)).select("id", "task"), "ngram-rest")
    rest = alive.select("id", "tokens").join(checked_broadcast(rest), "id")
    return _classes(edges.union(_solved(rest, num, den)), "ngram-classes")


_FLIP = "(-9223372036854775807L - 1L)"

#: Keys order sets by their least doc_id, null ids last; then by name.
_KEY = f"unhex(concat(if(row.doc_id IS NULL, '01', '00'), lpad(hex(coalesce(row.doc_id, 0L) ^ {_FLIP}), 16, '0'), hex(node)))"


def _labelled(docs: DataFrame, size: int, num: int, den: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sets (of _SETS), and (node, doc_id, text_hash, root) for every set: its first row and, if it links, its class."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("body"))
    sets = materialise(rows.mapInArrow(lean(_set_rows(size)), _SETS), "ngram-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("row")
    nodes = sets.where("node IS NOT NULL").groupBy("node").agg(first, F.max("n_shingles").alias("n"), F.max("ref").alias("ref"))
    nodes = materialise(nodes.withColumn("key", F.expr(_KEY)), "ngram-nodes")
    # short names of the sets, made again with another seed should two ever be alike
    seed = 0
    while not nodes.groupBy(F.xxhash64("node", F.lit(seed))).count().where("count > 1").isEmpty():
        seed += 1
    nodes = nodes.withColumn("id", F.xxhash64("node", F.lit(seed)))
    # a set may hold (den - num)/den of its n-grams alone; most texts hold far more, so a range a little wider tells
    bound = min(int((1.2 * (den - num) / den + 0.08) * (1 << 64)), (1 << 64) - 1)
    own = rows.select("body").mapInArrow(lean(_range_rows(size, bound)), "token long, ref long")
    own = own.groupBy("token").agg(F.min("ref").alias("ref"), F.max("ref").alias("high")).where("ref = high")
    alone = own.groupBy("ref").agg(F.count("*").alias("alone"))
    spare = F.expr(f"n * {den - num} div {den}")
    left = nodes.join(alone, "ref", "left").where(F.coalesce("alone", F.lit(0)) <= spare)
    left = materialise(left.select("id", "n", F.col("row.doc_id").alias("d"), F.col("row.text_hash").alias("t")), "ngram-left")
    may_hold = key_filter(left, F.xxhash64("d", "t"))
    tokens = rows.select("doc_id", "text_hash", "body", F.xxhash64("doc_id", "text_hash").alias("h"))
    tokens = tokens.mapInArrow(lean(_token_rows(size, may_hold)), "doc_id long, text_hash long, tokens array<long>")
    tokens = tokens.join(checked_broadcast(left), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).select("id", "n", "tokens")
    repeated = not sets.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    alive = materialise(tokens.dropDuplicates(["id"]) if repeated else tokens, "ngram-alive")
    each = alive.select("id", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held"))
    posts = shared.join(alive.select("id", "n"), "id").withColumn("many", F.size("held") - F.col("n") + spare + 1).where("many > 0")
    posts = materialise(posts.select("id", F.explode(F.expr("slice(held, 1, cast(many AS int)).token")).alias("token")), "ngram-posts")
    linked = nodes.select("id", "key").join(_links(alive, posts, num, den, most), "id")
    linked = linked.join(linked.groupBy("root").agg(F.min("key").alias("least")), "root").select("id", "least")
    labels = nodes.join(linked, "id", "left").select(
        "node", F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"), F.when(F.col("least") != F.col("key"), F.col("least")).alias("root")
    )
    return sets, labels


def ngram_classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, most: int = TASK_SHINGLES) -> DataFrame:
    """One row a document: doc_id, text_hash, n_shingles and component_id.

    Documents link when ``den * |x & y| >= num * |x | y|`` over their sets of ``size``-word
    shingles (A-Z lower-cased; a shorter text is one shingle).  component_id is the
    least doc_id reachable by links, its own included.  ``most`` bounds the shingles
    that a task joins at once; the result does not depend on it.

    Null and empty texts have no shingles and link with nothing.  Rows with a null
    doc_id take part but never give their class its id (a class of such rows alone has
    null).  Repeated rows are kept.  Extra columns are ignored.  An empty table gives
    an empty result.
    """
    sets, labels = _labelled(docs, size, num, den, most)
    # the class's key begins with its least doc_id
    least = F.expr(f"if(substring(hex(root), 1, 2) = '01', NULL, cast(conv(substring(hex(root), 3, 16), 16, -10) AS bigint) ^ {_FLIP})")
    named = labels.select("node", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(least).alias("component_id"))
    found = sets.join(named, "node", "left")
    return found.select("doc_id", "text_hash", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates_removed(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, most: int = TASK_SHINGLES) -> DataFrame:
    """The documents with one row of each class of near copies.

    It is the one with the least doc_id, null ids last, then the least by a hash of its
    shingles and of its text, then, of rows that repeat both doc_id and text, the least by
    all columns.  Documents without words stay as they are, unlinked.  All columns of
    ``docs`` are kept, whatever their names.
    """
    sets, labels = _labelled(docs, size, num, den, most)
    keys = sets.where("node IS NOT NULL").groupBy("doc_id", "text_hash", "node").agg(F.count("*").alias("n"))
    heads = labels.select("node", F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("root").isNull().alias("head"))
    first = F.col("head") & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    told = keys.join(heads, "node").select(F.col("doc_id").alias("told_id"), F.col("text_hash").alias("told_hash"), "n", first.alias("first"))
    # keys of which no row, or not every row, stays; of the latter one row each comes back
    told = materialise(told.where("n > 1 OR NOT first"), "ngram-told")
    again = materialise(told.where("first"), "ngram-again")
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = body.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("hash"))
    near, rest = parted(body.withColumn("h", F.xxhash64("id", "hash")), key_filter(told, F.xxhash64("told_id", "told_hash")))
    same = F.col("id").eqNullSafe(F.col("told_id")) & (F.col("hash") == F.col("told_hash"))
    one = near.join(again, same, "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rest.select("row.*").unionByName(near.join(told, same, "left_anti").select("row.*")).unionByName(one.select("row.*"))
