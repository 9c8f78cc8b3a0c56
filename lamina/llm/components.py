"""Connected components of an edge table, without collecting it.

Every partition reduces its edges to a forest by union-find (its memory is that of a partition, the result at
most one edge per node in it), then roots are replaced by their own roots through a join. Both repeat until every
node has one root that has none above it. Each step is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lookup, materialise

_SCHEMA = "node bigint, root bigint"
#: Roots up to this many (counted) are looked up by broadcast.
BROADCAST_ROOTS = 100_000


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column("node").to_pylist(), batch.column("root").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 100_000):
        part = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a`` and ``b``) but the roots; a root is its component's least node."""
    now = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).filter("node <> root")
    while True:
        now = materialise(now.repartition("node").mapInArrow(_forest, _SCHEMA), "forest")
        above = now.groupBy("node").agg(F.min("root").alias("above"), F.max("root").alias("other"))
        conflict = above.filter("above <> other").select("node")
        chained = now.select(F.col("root").alias("node")).join(now.select("node"), "node", "left_semi")
        if conflict.unionByName(chained).isEmpty():
            return now
        up = materialise(above.select(F.col("node").alias("root"), "above"), "above")
        moved = materialise(lookup(now, up, ["root"], BROADCAST_ROOTS), "moved")  # a giant component's root is a hot key
        links = moved.filter("above is not null").select(F.col("root").alias("node"), F.col("above").alias("root")).distinct()
        now = moved.select("node", F.coalesce("above", "root").alias("root")).unionByName(links).filter("node <> root")
