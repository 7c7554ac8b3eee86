"""Approximate nearest neighbours by inner product in a hierarchical k-means tree, searched best bin first.

Fit: a hashed sample of at most `SAMPLE_BYTES` of vectors is split by k-means, and each part again, until about 2 sqrt(rows)
leaves (4,096 at most, so the tree is a bounded broadcast) are left. Index: every row goes down the tree to one leaf. Search: a
priority queue holds tree nodes by the inner product that their best member is expected to have; the best node is
taken, and its children are queued or, if it is a leaf, its rows are visited. How many leaves a query visits is calibrated: for
a hashed sample of queries the exact neighbours among all rows are found, the visits are widened until the lower end of the
recall's confidence interval reaches the target, and every query then visits so many leaves, and more until they hold
more than k rows.

Leaves lie in groups of at most `group_rows` rows; a leaf with more (one vector may be a third of the table) is dealt over several
groups by row number. A query is sent once to each group that holds a leaf it visits, in packed blocks; a task streams the
blocks past one group. Inner products from matrix products only select; the kept candidates are computed again, each by
the same sum, so equal vectors have equal scores and ties are exact.

Defined cases: rows whose vector is null, empty, zero, holds null or non-finite components, or has another length than the first
kept row's, take no part. Rows with one id are different rows: each is a candidate of the other. A null id ranks behind
all others among ties. With at most k candidates all are returned. Extra columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.llm.codebooks import usable
from pitspark.llm.common import stored, table, with_row_id

SAMPLE_BYTES = 32 << 20
MOST_LEAVES = 4096
CALIBRATION_QUERIES = 256
OPTIMISM = 2.0  # deviations above the mean that the best member of a node is expected to lie
MESSAGE_QUERIES = 256


@dataclass
class Tree:
    """Nodes by number; children are consecutive, leaves are numbered in depth-first order."""

    centre: np.ndarray
    spread: np.ndarray  # root mean square of the members' distance along one direction
    child: np.ndarray  # first child, -1 for a leaf
    children: np.ndarray
    leaf: np.ndarray  # number of the leaf, -1 for an inner node
    rows: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # by leaf, over the whole table
    first_group: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    groups: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node to the closest child."""
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.flatnonzero(self.child[at] >= 0)
        while len(moving):
            for node in np.unique(at[moving]):
                here = moving[at[moving] == node]
                kids = slice(self.child[node], self.child[node] + self.children[node])
                c = self.centre[kids]
                at[here] = self.child[node] + ((c * c).sum(1) - 2 * (x[here] @ c.T)).argmin(1)
            moving = moving[self.child[at[moving]] >= 0]
        return self.leaf[at]

    def keys(self, q: np.ndarray) -> np.ndarray:
        """For each query and node the inner product that the best member is expected to have."""
        return q @ self.centre.T + OPTIMISM * np.sqrt((q * q).sum(1))[:, None] * self.spread

    def visit(self, keys: list[float], leaves: int, rows: int) -> list[int]:
        """Leaves with rows in best-bin-first order: `leaves` of them, and more until they hold more than `rows` rows."""
        found, held = [], 0
        queue = [(-keys[0], 0)]
        while queue and (len(found) < leaves or held <= rows):
            node = heapq.heappop(queue)[1]
            if self.leaf[node] < 0:
                for kid in range(self.child[node], self.child[node] + self.children[node]):
                    heapq.heappush(queue, (-keys[kid], kid))
            elif self.rows[self.leaf[node]]:
                found.append(int(self.leaf[node]))
                held += self.rows[self.leaf[node]]
        return found


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, turns: int = 8) -> np.ndarray:
    """The cluster of each row; clusters without rows do not count."""
    centre = x[rng.choice(len(x), k, replace=False)]
    of = np.zeros(len(x), dtype=np.int64)
    for _ in range(turns):
        of = ((centre * centre).sum(1) - 2 * (x @ centre.T)).argmin(1)
        used, of = np.unique(of, return_inverse=True)
        order = np.argsort(of, kind="stable")
        start = np.searchsorted(of[order], np.arange(len(used)))
        centre = np.add.reduceat(x[order], start, axis=0) / np.bincount(of)[:, None]
    return of


def fit(sample: np.ndarray, leaves: int, branch: int = 16, seed: int = 1) -> Tree:
    rng = np.random.default_rng(seed)
    target = max(1.0, len(sample) / leaves)
    nodes: list[list] = [[np.arange(len(sample)), -1, 0]]
    at = 0
    while at < len(nodes):  # breadth first, so children are consecutive
        rows = nodes[at][0]
        k = min(branch, round(len(rows) / target))
        if k > 1:
            of = _kmeans(sample[rows], k, rng)
            if of.max() > 0:
                nodes[at][1:] = len(nodes), int(of.max()) + 1
                nodes += [[rows[of == c], -1, 0] for c in range(int(of.max()) + 1)]
        at += 1
    centre = np.stack([sample[n[0]].mean(axis=0) for n in nodes])
    spread = np.array([np.sqrt(((sample[n[0]] - c) ** 2).mean()) for n, c in zip(nodes, centre)])
    leaf, stack, number = np.full(len(nodes), -1), [0], 0
    while stack:
        node = stack.pop()
        if nodes[node][1] < 0:
            leaf[node] = number
            number += 1
        else:
            stack += range(nodes[node][1] + nodes[node][2] - 1, nodes[node][1] - 1, -1)
    return Tree(centre, spread, np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes]), leaf)


def _vectors(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1).astype(np.float64)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products, each summed in the same order."""
    return (q * x).sum(axis=1)


def _best(q: np.ndarray, x: np.ndarray, approx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all rows that may be among the k best of a query; -inf in `approx` is no candidate."""
    m = min(k, approx.shape[1])
    edge = -np.partition(-approx, m - 1, axis=1)[:, m - 1]
    slack = 1e-12 * np.sqrt((q * q).sum(1) * (x * x).sum(1).max(initial=0.0))
    qi, xi = np.nonzero((approx >= (edge - slack)[:, None]) & (approx > -np.inf))
    score = np.concatenate([_scores(q[qi[a : a + 50_000]], x[xi[a : a + 50_000]]) for a in range(0, len(qi), 50_000)]) if len(qi) else np.empty(0)
    return qi, xi, score


def _first_k(qi: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of `order`, sorted by query first, the first k of each query."""
    q = qi[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[nth < k]


@dataclass
class _Exact:
    """Per task: the k best rows of each calibration query among the task's rows."""

    rids: np.ndarray
    queries: np.ndarray
    kind: str
    k: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            for at in range(0, len(batch), 2048):
                rid, leaf, v = (batch.slice(at, 2048).column(i) for i in range(3))
                x, rid, leaf = _vectors(v, self.kind), rid.to_numpy(), leaf.to_numpy()
                approx = self.queries @ x.T
                approx[self.rids[:, None] == rid[None, :]] = -np.inf
                qi, xi, score = _best(self.queries, x, approx, self.k)
                held = [np.concatenate(p) for p in zip(held, (qi, score, rid[xi], leaf[xi]))]
                keep = _first_k(held[0], np.lexsort((held[2], -held[1], held[0])), self.k)
                held = [h[keep] for h in held]
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["q", "score", "rid", "leaf"])


@dataclass
class _Send:
    """Queries to the groups that hold their leaves, some hundred in one row."""

    tree: object
    kind: str
    leaves: int
    k: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = self.tree.value
        for batch in batches:
            for at in range(0, len(batch), MESSAGE_QUERIES):
                some = batch.slice(at, MESSAGE_QUERIES)
                keys = tree.keys(_vectors(some.column(2), self.kind))
                to: dict[int, tuple[list, list]] = {}
                for i, row in enumerate(keys):
                    for leaf in tree.visit(row.tolist(), self.leaves, self.k):
                        for group in range(tree.first_group[leaf], tree.first_group[leaf] + tree.groups[leaf]):
                            who, what = to.setdefault(group, ([], []))
                            who.append(i)
                            what.append(leaf)
                rid, name, v = (some.column(i).to_pylist() for i in range(3))
                out = []
                for group, (who, what) in to.items():
                    q, of = np.unique(who, return_inverse=True)
                    out.append((group, 1, [rid[i] for i in q], [name[i] for i in q], b"".join(v[i] for i in q), of.tolist(), what))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _MESSAGE.types)], schema=_MESSAGE)


_MESSAGE = pa.schema(
    [("grp", pa.int64()), ("kind", pa.int32()), ("rids", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("v", pa.binary()), ("of", pa.list_(pa.int32())), ("leaf", pa.list_(pa.int32()))]
)
_MESSAGE_DDL = "grp long, kind int, rids array<long>, ids array<long>, v binary, of array<int>, leaf array<int>"


@dataclass
class _Meet:
    """Streams rows ordered by group, index rows before queries: each block of queries meets the group's rows."""

    kind: str
    k: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, index = None, [], None
        for batch in batches:
            groups, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero((groups[1:] != groups[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(groups)]):
                if groups[a] != group:
                    group, held, index = groups[a], [], None
                some = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append((some.column(2).flatten().to_numpy(zero_copy_only=False), some.column(3).flatten(), _vectors(some.column(4), self.kind), some.column(6).flatten().to_numpy(zero_copy_only=False)))
                    continue
                if index is None:
                    index, held = self._index(held), []
                for i in range(len(some)):
                    row = [some.column(c)[i] for c in range(2, 7)]
                    yield from self._answer(index, *row)

    def _index(self, held: list) -> tuple:
        rid, leaf = np.concatenate([h[0] for h in held]), np.concatenate([h[3] for h in held])
        ids, x = pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])
        order = np.argsort(leaf, kind="stable")
        return rid[order], ids.take(pa.array(order)), x[order], leaf[order]

    def _answer(self, index: tuple, rids, ids, v, of, what) -> Iterator[pa.RecordBatch]:
        rid, names, x, leaf = index
        q_rid, of, what = rids.values.to_numpy(), of.values.to_numpy(), what.values.to_numpy()
        q = np.frombuffer(v.as_py(), dtype=self.kind).reshape(len(q_rid), -1).astype(np.float64)
        approx = np.full((len(q), len(x)), -np.inf)
        order = np.argsort(what, kind="stable")
        of, what = of[order], what[order]
        for a, b in zip(*(np.searchsorted(what, np.unique(what), side=s) for s in ("left", "right"))):
            lo, hi = np.searchsorted(leaf, what[a], side="left"), np.searchsorted(leaf, what[a], side="right")
            if hi > lo:
                approx[of[a:b], lo:hi] = q[of[a:b]] @ x[lo:hi].T
        by = np.argsort(rid)
        own = by[np.minimum(np.searchsorted(rid[by], q_rid), len(rid) - 1)]
        mine = np.flatnonzero(rid[own] == q_rid)
        approx[mine, own[mine]] = -np.inf
        qi, xi, score = _best(q, x, approx, self.k)
        known = names.is_valid().to_numpy(zero_copy_only=False)
        number = names.fill_null(0).to_numpy()
        keep = _first_k(qi, np.lexsort((rid[xi], number[xi], ~known[xi], -score, qi)), self.k)
        qi, xi, score = qi[keep], xi[keep], score[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(q_rid[qi]), ids.values.take(pa.array(qi)), names.take(pa.array(xi)), pa.array(rid[xi]), pa.array(score)],
            names=["query_rid", "query_id", "vec_id", "rid", "score"],
        )


@dataclass
class Search:
    """`found` (query_rid, query_id, rank, vec_id, rid, score) and what the calibration said."""

    found: DataFrame
    leaves: int
    visits: int
    calibrated: float


def _calibrate(tree: Tree, queries: np.ndarray, near: list[list[int]], k: int, recall: float) -> tuple[int, float]:
    """The smallest number of visits whose recall, less two standard errors, reaches `recall`; with its mean recall."""
    ranks = []
    for keys, leaves in zip(tree.keys(queries), near):
        order = tree.visit(keys.tolist(), tree.leaves, 0)
        place = {leaf: i + 1 for i, leaf in enumerate(order)}
        ranks.append(np.array([place[leaf] for leaf in leaves]))
    visits = 1
    while True:
        share = np.array([(r <= visits).mean() if len(r) else 1.0 for r in ranks])
        if share.mean() - 2 * share.std() / np.sqrt(len(share)) >= recall or visits >= tree.leaves:
            return visits, float(share.mean())
        visits += 1


def search(
    vectors: DataFrame, queries: Column, vector: str = "embedding", id_column: str = "vec_id", *, k: int = 20, recall: float = 0.95, group_rows: int = 8192, leaves: int | None = None
) -> Search:
    """The k nearest rows found for each row that `queries` selects, by inner product; ids are integers."""
    spark = vectors.sparkSession
    rows = with_row_id(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")))
    rows = rows.filter(usable(F.col("v"))).filter(F.exists("v", lambda x: x != 0))
    total, length, asked = rows.agg(F.count("*"), F.min_by(F.size("v"), F.struct(F.col("id").isNull(), "id", "v")), F.count_if("is_query")).first()
    empty = "query_rid long, query_id long, rank int, vec_id long, rid long, score double"
    if not asked:
        return Search(spark.createDataFrame([], empty), 0, 0, 1.0)
    single = vectors.schema[vector].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    rows = rows.filter(F.size("v") == length).withColumn("v", F.col("v").cast("array<float>" if single else "array<double>"))

    def hashed(want: int, of: int) -> Column:
        return F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, want / of)))

    want = max(1, SAMPLE_BYTES // (8 * length))
    sample = rows.filter(hashed(want, total)).select("v").toArrow()["v"].combine_chunks()
    flat = (sample.flatten() if len(sample) else pa.array([], pa.float64())).to_numpy(zero_copy_only=False).astype(np.float64)
    flat = flat.reshape(-1, length) if len(flat) else np.zeros((1, length))
    tree = fit(flat, max(1, min(MOST_LEAVES, leaves or round(2 * total**0.5), len(flat))))

    share = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(batch), -1)
            cuts = pa.py_buffer((np.arange(len(batch) + 1) * v.itemsize * length).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, cuts, pa.py_buffer(np.ascontiguousarray(v))])
            leaf = pa.array(share.value.place(v.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, leaf, batch.column(3)], names=["rid", "id", "v", "leaf", "is_query"])

    index = stored(rows.select("rid", "id", "v", "is_query").mapInArrow(place, "rid long, id long, v binary, leaf long, is_query boolean"))
    tree.rows = np.zeros(tree.leaves, dtype=np.int64)
    for leaf, n in index.groupBy("leaf").count().collect():
        tree.rows[leaf] = n
    tree.first_group, tree.groups = np.zeros((2, tree.leaves), dtype=np.int64)
    group, room = 0, group_rows
    for leaf, n in enumerate(tree.rows.tolist()):
        if n > room:
            group, room = (group + 1, group_rows) if room < group_rows else (group, group_rows)
        tree.first_group[leaf], tree.groups[leaf] = group, max(1, -(-n // group_rows))
        group, room = (group, room - n) if n <= group_rows else (group + int(tree.groups[leaf]), group_rows)

    some = index.filter("is_query").filter(hashed(CALIBRATION_QUERIES, asked)).orderBy("rid").select("rid", "v").collect()
    if some:
        known = np.stack([np.frombuffer(bytes(r.v), dtype=kind) for r in some]).astype(np.float64)
        exact = index.select("rid", "leaf", "v").mapInArrow(_Exact(np.array([r.rid for r in some]), known, kind, k), "q long, score double, rid long, leaf long")
        best = Window.partitionBy("q").orderBy(F.desc("score"), "rid")
        near: list[list[int]] = [[] for _ in some]
        for q, leaf in exact.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("q", "leaf").collect():
            near[q].append(leaf)
        visits, calibrated = _calibrate(tree, known, near, k, recall)
    else:
        visits, calibrated = tree.leaves, 1.0

    share = spark.sparkContext.broadcast(tree)
    sent = index.filter("is_query").select("rid", "id", "v").mapInArrow(_Send(share, kind, visits, k), _MESSAGE_DDL)
    where = spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(tree.first_group, tree.groups))], "leaf long, first long, n long")
    at = F.col("first") + F.pmod(F.xxhash64("rid"), F.col("n"))
    own = index.join(F.broadcast(where), "leaf").select(
        at.alias("grp"), F.lit(0).alias("kind"), F.array("rid").alias("rids"), F.array("id").alias("ids"), "v", F.array(F.lit(0)).alias("of"), F.array(F.col("leaf").cast("int")).alias("leaf")
    )
    groups = int(tree.first_group[-1] + tree.groups[-1])
    met = own.unionByName(sent).repartition(max(1, min(2 * groups, 10_000)), "grp").sortWithinPartitions("grp", "kind")
    pairs = met.mapInArrow(_Meet(kind, k), "query_rid long, query_id long, vec_id long, rid long, score double")
    rank = F.row_number().over(Window.partitionBy("query_rid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid"))
    found = pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_rid", "query_id", "rank", "vec_id", "rid", "score")
    return Search(found, tree.leaves, visits, calibrated)


def query(spark, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).found
    return found.select("query_id", "rank", "vec_id", "score")
