"""Connected components of a large graph by rounds of contraction.

Every node points at its smallest neighbour in a pseudo-random order that changes
by round; nodes that point at the same one merge. Each round removes a constant share
of the nodes whatever the shape of the graph (long chains, stars, cliques), so the
tables shrink geometrically and the number of rounds is logarithmic. No round
gathers a component or a neighbour list: a node's choice is a minimum that combines
before the shuffle.

A graph of at most ``SMALL`` edges, from the start or after some rounds, is finished in one
pass. A round is a dozen stages on every partition whatever is left in it, and what the driver
keeps of them is memory that a few edges do not deserve.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contest_analytics.llm.common import saved

#: Edges that one pass takes, 16 bytes each.
SMALL = 1_000_000


def _finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node``, ``root`` of at most ``SMALL`` edges; the smallest node of each component is its root."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches if b.num_rows]
    if not ends:
        return
    nodes, places = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = places.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        # Roots take the smallest root they touch, then every node that of its root.
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node``, ``root`` for each node of ``edges`` (longs ``a``, ``b``).

    ``root`` is one node of the component, the same for all of its nodes. Loops,
    repeated edges and null ends are ignored; an empty input gives no rows.
    """
    left = saved(_simple(edges))
    steps: list[DataFrame] = []
    while (size := left.count()) > SMALL:
        if len(steps) == max_rounds:
            raise RuntimeError(f"components not found within {max_rounds} rounds")
        seed = F.lit(len(steps))
        both = left.union(left.select("b", "a"))
        # Ordered by a hash of the round and the node; the node itself takes part.
        ends = both.union(both.select("a", "a").distinct()).toDF("node", "next")
        rank = F.struct(F.xxhash64(seed, F.col("next")).alias("h"), F.col("next").alias("next"))
        step = saved(ends.groupBy("node").agg(F.min(rank).alias("m")).select("node", F.col("m.next").alias("root")))
        steps.append(step)
        here = left.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b")
        left = saved(_simple(here.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    # Each table is written, as no plan may hold the work of all rounds.
    found = saved(left.coalesce(1).mapInArrow(_finish, "node long, root long")) if size else None
    # A node's root may itself have moved on in later rounds.
    for step in reversed(steps):
        if found is None:
            found = step
            continue
        later = found.toDF("root", "last")
        found = saved(step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found


def _simple(edges: DataFrame) -> DataFrame:
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered.filter("a < b").distinct()
