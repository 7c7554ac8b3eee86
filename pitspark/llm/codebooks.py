"""Product codes of vectors by integer k-means with the adaptive bounds of Drake and Hamerly.

Vectors become integers, are cut into parts, and each part gets a codebook by a fixed number of rounds of assignment and
update. Every row keeps, for each part, its assigned entry and the b next closest ones with lower bounds on their distances
in ascending order, and one outer bound for all other entries. After an update the bounds shrink by what the entries moved. The
distance to the assigned entry is computed exactly; the first bound it stays under says how many entries of the list can
be closer, mostly none. Those, and only those, are compared in exact integer arithmetic, ties to the lower index; a row whose
outer bound fails looks at the whole codebook and gets a new list. Bounds are rounded against themselves, so an uncertain
case always ends in the integer comparison and codes equal those of the plain method.

b is adapted for each part and round: from a histogram of how many entries were needed, to the smallest b that leaves one
row in a hundred without an answer, and twice as many where more than a quarter of the rows needed the whole codebook.

A round reads and writes one table (bounds, integers, codes) and sums each task's members of an entry; the driver holds the
codebooks and their sums: parts x entries x width numbers, whatever the table's size. Equal vectors, however many, cost a
row each and meet only in these sums. Errors are summed by label in each partition before they meet.

Defined cases: rows whose vector is null, empty, holds null or non-finite components, or has another length than the first
kept row's, are dropped. A null id ranks behind all others; equal ids are ordered by their vectors. With fewer rows than
entries the codebook has one entry for each row. A length that `parts` does not divide is cut as evenly as possible.
Components beyond about 2**17 (for 16 wide parts), whose squared distances leave 64 bits, raise an error. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import drop_stored, stored_at, table

FIRST_B, LEAST_B, MOST_B = 8, 2, 24
_SLACK = 1e-5  # relative, against float32 rounding


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 52:  # every sum is an integer that a double holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


def _floor32(d: np.ndarray) -> np.ndarray:
    """The root of squared distances as a float32 that is never above it."""
    return (np.sqrt(d.astype(np.float64)) * (1 - _SLACK)).astype(np.float32)


def _whole(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the whole codebook: the b+1 closest entries in order, b+1 bounds and the outer one, and the smallest squared distance."""
    k = len(entries)
    key = _squares(x, entries) * k + np.arange(k)  # orders by distance, then index
    if k > b + 2:
        key = np.partition(key, b + 1, axis=1)[:, : b + 2]
    key.sort(axis=1)
    d, near = np.divmod(key, k)
    low = np.full((len(x), b + 2), np.inf, dtype=np.float32)
    low[:, : d.shape[1]] = _floor32(d)
    out = np.repeat(near[:, :1], b + 1, axis=1)
    got = min(b + 1, near.shape[1])
    out[:, :got] = near[:, :got]
    return out, low, d[:, 0]


@dataclass
class Bounds:
    """Of one part: `near` (rows, b+1), the assigned entry first, and `low` (rows, b+2), the outer bound last."""

    near: np.ndarray
    low: np.ndarray

    def resized(self, b: int) -> Bounds:
        have = self.near.shape[1] - 1
        if b == have:
            return self
        if b < have:
            return Bounds(self.near[:, : b + 1], np.concatenate((self.low[:, : b + 1], self.low[:, b + 1 :].min(axis=1, keepdims=True)), axis=1))
        # the assigned entry again, under the outer bound: says nothing new and does no harm
        pad = b - have
        return Bounds(
            np.concatenate((self.near, np.repeat(self.near[:, :1], pad, axis=1)), axis=1),
            np.concatenate((self.low, np.repeat(self.low[:, -1:], pad, axis=1)), axis=1),
        )


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, old: Bounds, b: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """New bounds with `b` listed entries, the squared distance of each row to its entry, and how many listed entries each
    row had to look at (one more than are listed: the whole codebook)."""
    listed = old.near.shape[1] - 1
    near, low = old.near.copy(), old.low.astype(np.float64)
    low[:, :-1] -= moved[near]
    low[:, -1] -= moved.max(initial=0.0)
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1] - 1e-6  # bound z holds for entry z and all behind it
    best = ((x - entries[near[:, 0]]) ** 2).sum(1)
    upper = np.sqrt(best.astype(np.float64)) * (1 + _SLACK)
    need = (upper[:, None] >= low[:, 1:]).sum(1)  # ascending, so the failing bounds are the first ones
    low[:, 0] = _floor32(best)
    for z in range(1, listed + 1):
        rows = np.flatnonzero(need == z)
        if len(rows):
            some = near[rows, : z + 1]
            key = ((x[rows, None, :] - entries[some]) ** 2).sum(2) * len(entries) + some
            key.sort(axis=1)
            d, near[rows, : z + 1] = np.divmod(key, len(entries))
            low[rows, : z + 1] = _floor32(d)
            best[rows] = d[:, 0]
    out = Bounds(near, low.astype(np.float32)).resized(b)
    rows = np.flatnonzero(need == listed + 1)
    if len(rows):
        near, low, best[rows] = _whole(x[rows], entries, b)
        out = Bounds(out.near.copy(), out.low.copy())
        out.near[rows], out.low[rows] = near, low
    return out, best, need


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), width)


def _binary(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values)
    step = flat.dtype.itemsize * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer((np.arange(len(flat) + 1) * step).astype(np.int32)), pa.py_buffer(flat)])


@dataclass
class _Round:
    """One pass: assigns every part and sums the members of every entry."""

    cuts: list[tuple[int, int]]
    entries: list[np.ndarray]
    listed: list[int] | None  # b of each part as read; None: vectors, in the first pass
    write: list[int]
    moved: list[np.ndarray]
    scale: float
    ints: str  # numpy type of the stored integers
    width: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = range(len(self.cuts))
        sums = [np.zeros((len(e), e.shape[1]), dtype=np.int64) for e in self.entries]
        counts = [np.zeros(len(e), dtype=np.int64) for e in self.entries]
        needs = [np.zeros(MOST_B + 3, dtype=np.int64) for _ in parts]
        kind = "<u1" if len(self.entries[0]) <= 256 else "<u2"
        schema = None
        for batch in batches:
            schema = schema or self._schema(batch.schema)
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                x, old = self._read(some, kind)
                near, low, code, error = [], [], [], np.zeros(len(x), dtype=np.int64)
                for p in parts:
                    own = x[:, self.cuts[p][0] : self.cuts[p][1]]
                    if old is None:
                        n, lo, d = _whole(own, self.entries[p], self.write[p])
                        bounds, need = Bounds(n, lo), np.zeros(len(x), dtype=np.int64)
                    else:
                        bounds, d, need = reassign(own, self.entries[p], self.moved[p], old[p], self.write[p])
                        need = np.where(need > self.listed[p], MOST_B + 2, need)
                    needs[p] += np.bincount(need, minlength=MOST_B + 3)
                    first = bounds.near[:, 0]
                    np.add.at(sums[p], first, own)
                    counts[p] += np.bincount(first, minlength=len(counts[p]))
                    near.append(bounds.near)
                    low.append(bounds.low)
                    code.append(first)
                    error += d
                n = len(x)
                stats = [pa.nulls(n, f.type) for f in schema][7:]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), _binary(x.astype(self.ints)), _binary(np.concatenate(near, axis=1).astype(kind)), _binary(np.concatenate(low, axis=1)),
                     _binary(np.stack(code, axis=1).astype(kind)), pa.array(error), *stats],
                    schema=schema,
                )
        if schema is None:
            return
        part = np.concatenate([np.full(len(c), p) for p, c in enumerate(counts)])
        n, wide = len(part), np.zeros((len(part), self.width), dtype=np.int64)
        at = 0
        for s in sums:
            wide[at : at + len(s), : s.shape[1]] = s
            at += len(s)
        need = np.zeros((n, MOST_B + 3), dtype=np.int64)
        for p in parts:
            need[sum(len(c) for c in counts[:p])] = needs[p]
        longs = [part, np.concatenate([np.arange(len(c)) for c in counts]), np.concatenate(counts), *wide.T, *need.T]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, f.type) for f in schema][:7], *[pa.array(np.ascontiguousarray(v), pa.int64()) for v in longs]], schema=schema)

    def _schema(self, read: pa.Schema) -> pa.Schema:
        fixed = [("x", pa.binary()), ("near", pa.binary()), ("low", pa.binary()), ("code", pa.binary()), ("error", pa.int64())]
        return pa.schema([read.field(0), read.field(1), *fixed, *[(c, pa.int64()) for c in self.stats()]])

    def stats(self) -> list[str]:
        return ["part", "entry", "n", *[f"s{i}" for i in range(self.width)], *[f"z{i}" for i in range(MOST_B + 3)]]

    def _read(self, batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, list[Bounds] | None]:
        length = self.cuts[-1][1]
        if self.listed is None:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            return np.floor(self.scale * flat).astype(np.int64).reshape(len(batch), length), None
        x = _matrix(batch.column(2), self.ints, length).astype(np.int64)
        near = _matrix(batch.column(3), kind, sum(b + 1 for b in self.listed)).astype(np.int64)
        low = _matrix(batch.column(4), "<f4", sum(b + 2 for b in self.listed))
        old, at = [], 0
        for p, b in enumerate(self.listed):
            old.append(Bounds(near[:, at : at + b + 1], low[:, at + p : at + p + b + 2]))
            at += b + 1
        return x, old


@dataclass
class Codes:
    """`rows` (row, node, code, error): the kept columns as a struct, the partition, one index a part, the squared error;
    `codebooks`: the entries of each part; `compared`: the share of row, part and entry triples that each pass after the
    first one compared; `listed`: b by pass and part."""

    rows: DataFrame
    codebooks: list[np.ndarray]
    compared: list[float]
    listed: list[list[int]]


def _adapted(b: int, needs: np.ndarray) -> int:
    rows, whole = needs.sum(), needs[-1]
    if rows and 4 * whole > rows:
        return min(MOST_B, 2 * b)
    short = np.flatnonzero(np.cumsum(needs[:-1]) >= 0.99 * (rows - whole))
    return int(np.clip(short[0] if len(short) else b, LEAST_B, MOST_B))


def compress(
    vectors: DataFrame, vector: str = "embedding", order: str = "vec_id", keep: tuple[str, ...] = ("vec_id", "label"), *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0
) -> Codes:
    """Codes of all usable rows; the codebooks start as the parts of the `entries` rows with the smallest `order`."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vector))).select(F.struct(*keep).alias("row"), F.col(order).alias("__by"), F.col(vector).alias("v"))
    first = rows.orderBy(F.col("__by").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        none = rows.select("row", F.lit(0).cast("long").alias("node"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return Codes(none, [], [], [])
    length = len(first[0].v)
    rows = rows.filter(F.size("v") == length)
    start = np.floor(scale * np.array([r.v for r in first if len(r.v) == length], dtype=np.float64))
    most = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    edge = [round(p * length / parts) for p in range(parts + 1)]
    cuts = list(zip(edge[:-1], edge[1:]))
    width = max(b - a for a, b in cuts)
    if 4 * width * (scale * most + 1) ** 2 * len(start) >= 2.0**63:
        raise ValueError("components are too large for squared distances in 64 bits")
    ints = next(t for t, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if scale * most + 1 < top)
    books = [start[:, a:b].astype(np.int64) for a, b in cuts]
    now = rows.select("row", F.spark_partition_id().cast("long").alias("node"), "v")
    listed, write, moved, path = None, [min(FIRST_B, len(start) - 1)] * parts, [np.zeros(len(start))] * parts, None
    compared, bs = [], []
    for turn in range(rounds + 1):
        step = _Round(cuts, books, listed, write, moved, scale, ints, width)
        kept = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
        names = ", ".join(f"{c} long" for c in step.stats())
        after, used = stored_at(now.mapInArrow(step, f"row struct<{kept.replace('` ', '`: ')}>, node long, x binary, near binary, low binary, code binary, error long, {names}"))
        if path:
            drop_stored(spark, path)
        path = used
        totals = after.filter(F.col("part").isNotNull()).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in step.stats()[2:]]).collect()
        needs = [np.zeros(MOST_B + 3, dtype=np.int64) for _ in books]
        fresh = [b.copy() for b in books]
        for t in totals:
            numbers = np.array(t[2:], dtype=np.int64)
            needs[t.part] += numbers[1 + width :]
            if numbers[0]:
                fresh[t.part][t.entry] = numbers[1 : 1 + books[t.part].shape[1]] // numbers[0]
        if listed:
            seen = sum(int((n[:-1] * (1 + np.arange(len(n) - 1))).sum() + n[-1] * len(start)) for n in needs)
            compared.append(seen / (sum(int(n.sum()) for n in needs) * len(start)))
        bs.append(list(write))
        if turn == rounds:
            break
        now, listed = after.filter(F.col("part").isNull()).select("row", "node", "x", "near", "low"), write
        write = [min(_adapted(b, n) if turn else b, len(start) - 1) for b, n in zip(write, needs)]
        moved = [np.sqrt(((f - b) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK) for f, b in zip(fresh, books)]
        books = fresh
    return Codes(after.filter(F.col("part").isNull()).select("row", "node", "code", "error"), books, compared, bs)


def with_label_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """Add the error summed over equal labels, nulls together. A label's rows are summed in each partition, and get the
    total through (partition, label), so no label's rows meet in one task."""
    group = F.struct(F.col(f"row.{label}"))
    rows = rows.withColumn("group", group)
    local = rows.groupBy("node", "group").agg(F.sum("error").alias("part_error"))
    totals = local.groupBy("group").agg(F.sum("part_error").alias("label_error"))
    back = local.select("node", "group").join(totals, "group")
    return rows.join(back, ["node", "group"]).drop("group")


def query(spark, sf_dir: str) -> DataFrame:
    done = compress(table(spark, sf_dir, "embeddings"))
    text = ",".join(str(x) for book in done.codebooks for x in book.ravel().tolist())
    rows = with_label_error(done.rows)
    return rows.select(
        "row.vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256")
    )


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    assigned = """SELECT i, p, arg_min(e, d * 65536 + e) AS e, min(d) AS d
  FROM (SELECT x.i, x.p, b.e, sum((x.v - b.c) * (x.v - b.c)) AS d FROM x JOIN {book} b ON x.p = b.p AND x.j = b.j GROUP BY x.i, x.p, b.e) GROUP BY i, p"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({assigned.format(book=f'b{r}')})")
        steps.append(
            f"""b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.j, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT p, j, e, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS c
    FROM (SELECT x.p, x.j, a.e, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{r} a ON x.i = a.i AND x.p = a.p GROUP BY x.p, x.j, a.e)
  ) n ON b.p = n.p AND b.j = n.j AND b.e = n.e)"""
        )
    steps.append(f"last AS MATERIALIZED ({assigned.format(book=f'b{rounds}')})")
    chain = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, embedding AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS MATERIALIZED (
  SELECT i, (t - 1) // (len(v) // {parts}) AS p, (t - 1) % (len(v) // {parts}) AS j, CAST(floor(1024 * CAST(v[t] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT i, v, unnest(range(1, len(v) + 1)) AS t FROM kept)
), b0 AS MATERIALIZED (
  SELECT p, j, i - 1 AS e, v AS c FROM x WHERE i <= {entries}
), {chain}, book AS (
  SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds}
), coded AS (
  SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY i
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (i) CROSS JOIN book
"""


ORACLE = _oracle()
