"""Connected components of a distributed edge list; nothing of the graph reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, small_batches

#: Edges that one task contracts, which bounds its memory.
TASK_EDGES = 400_000


def _contract(most: int):
    """Edges to a star from the least node of each of their components, ``most`` edges at a time."""

    def star(parent: dict, root, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for i in range(0, len(nodes), 4096):
            part = nodes[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], names=["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        held, kind = 0, None

        def root(x):
            while (up := parent[x]) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            kind = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                held += 1
                if held == most:
                    yield from star(parent, root, kind)
                    parent.clear()
                    held = 0
        yield from star(parent, root, kind)

    return run


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the least node reachable.

    Each task first contracts as many edges as it may hold to stars.  If all fitted one
    task, that is the answer.  Else least labels spread over the stars with pointer
    jumping, so paths shrink by doubling: each round takes the least label among a node
    and its neighbours, then the label of that label.  Rounds are written to the shared
    folder, which cuts the lineage; only counts come to the driver.  Empty edges give no
    rows; null ends, loops and repeated edges change nothing.
    """
    small_batches(edges.sparkSession)
    kind = edges.schema["a"].dataType.simpleString()
    held = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b"), tag)
    tasks = max(1, -(-held.count() // TASK_EDGES))
    stars = materialise(held.coalesce(tasks).mapInArrow(_contract(TASK_EDGES), f"node {kind}, root {kind}"), tag)
    if tasks == 1:
        return stars
    near = stars.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    both = materialise(near.union(near.select("b", "a")).distinct(), tag)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")), tag)
    while True:
        least = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        first = labels.join(least, labels.node == least.a, "left").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        step = materialise(
            first.join(jump, first.root == jump.via, "left").select(
                "node", F.least("root", F.coalesce("far", "root")).alias("root"), "old"
            ),
            tag,
        )
        labels = step.select("node", "root")
        if step.where("root <> old").isEmpty():
            return labels
