"""Connected components of a link table: links are joined in pieces of bounded size, then by alternating large-star and
small-star rounds if there are several pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pitspark.llm.common import stored

PIECE = 1 << 18  # links that one task joins


def _counted(df: DataFrame, rows: Column) -> tuple[DataFrame, int]:
    """`stored`, and the number of rows for which `rows` holds, taken while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(rows).alias("n")))
    return out, seen.get["n"]


def _large_star(edges: DataFrame) -> tuple[DataFrame, int]:
    """Link the larger neighbours of each node to the smallest of its neighbours and itself. Also: how many links that moves."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")))
    # both sides of the join come from files, so that a node with very many neighbours can be split at run time
    moved = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") != F.col("a")).alias("moved"))
    return _counted(moved.filter(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.max("moved").alias("moved")), F.col("moved"))


def _small_star(edges: DataFrame) -> tuple[DataFrame, int]:
    """Link each node and its smaller neighbours to the smallest of them. `edges` have a > b. Also: how many nodes have several."""
    least, several = _counted(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), F.col("n") > 1)
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), several


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.split(at, 2)
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[x], least[y])
        before = least.copy()
        for side in (x, y):
            np.minimum.at(least, before[side], low)  # the root's own entry, so that whole trees move
        while (least != (up := least[least])).any():
            least = up
        if (least == before).all():
            break
    inner = least != np.arange(len(nodes))
    return nodes[inner], nodes[least[inner]]


def _joined(edges: DataFrame, pieces: int, most: int) -> DataFrame:
    """The links of each of at most `pieces` groups of files as stars; groups that come out larger are cut."""

    def run(batches):
        held, rows = [], 0

        def flush():
            a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _stars(a, b)], names=["a", "b"])

        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                if rows and rows + len(part) > 4 * most:
                    yield flush()
                    held, rows = [], 0
                held.append((part.column("a").to_numpy(), part.column("b").to_numpy()))
                rows += len(part)
        if held:
            yield flush()

    return edges.coalesce(pieces).mapInArrow(run, "a long, b long")


def components(links: DataFrame, most: int = PIECE) -> DataFrame:
    """(node, component) of every node with a link to another one; `links` has two long columns a and b, the component is
    its smallest node.

    About `most` links (never over four times as many) are joined by one task, so that few links take no rounds: rounds
    are many small jobs, and the driver keeps a record of each task. More links go through the rounds, which end when
    neither star would change anything; their number grows like a logarithm.
    """
    first = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, n = _counted(first, F.lit(True))
    edges = stored(_joined(edges, max(1, -(-n // most)), most).distinct() if n > most else _joined(edges, 1, most))
    while n > most:
        large, moved = _large_star(edges)
        small, several = _small_star(large.select("a", "b"))
        if not moved and not several:
            break
        edges = stored(small)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
