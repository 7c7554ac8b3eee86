"""Periodic runs of words by a dictionary of basic factors.

Level k of the dictionary names every stretch of 2**k words of a text: two stretches of a text have one name if and only
if they are equal. Names of level k+1 are pairs of names of level k, made dense by one sort; a stretch that occurs once
gets no name, and neither does a longer one that holds it, so the dictionary of ordinary prose ends after a few levels.

The sort also lists the occurrences of each name. Occurrences at most half a stretch apart form an arithmetic progression
whose step is the smallest period of the stretch; a name has at most five progressions within twice its length. A run of
period q, 2**k <= q < 2**(k+1), holds two occurrences q words apart that lie in different progressions, so the differences
between neighbouring progressions, one proposal for each, miss no period. (Level 2 also stands for periods below four:
there the step of a progression is a period itself.) Proposals are extended to both sides by binary descent through the
levels and deduplicated; of several periods of one stretch the smallest stays. Names are ranks, never hashes: exact.

A text is one row and is worked on as a whole; texts share a task in slices of a few MB, so a worker's memory depends
on the slice and the longest text only.

Defined cases: a null text has no words, no runs and the empty collapsed text. A null id is passed on. Every input row gives
one row, so repeated rows, repeated ids and ties give repeated rows. Very long words are words. Other columns are not read, so
their names don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import slices, table

SHORTEST = 12  # words of a run
_LEAST = 2  # level of the first proposals


def _name(at: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names by position (-1: none) of the stretches at the ascending positions `at`, and (position, name) of those that
    recur, ordered by name and position."""
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(at) else np.empty(0, np.int64)
    again = np.bincount(group, minlength=1)[group] > 1
    at, group = at[again], group[again]
    name = np.full(n, -1, dtype=np.int32)
    name[at] = group
    return name, at, group


def _proposals(at: np.ndarray, group: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) from the occurrences of one level's names."""
    size = 1 << level
    joined = (group[1:] == group[:-1]) & (at[1:] - at[:-1] <= size // 2)
    head = np.flatnonzero(np.concatenate(([True], ~joined)))
    tail = np.concatenate((head[1:], [len(at)])) - 1
    first, last, members, name = at[head], at[tail], tail - head + 1, group[head]
    step = np.where(members > 1, at[np.minimum(head + 1, tail)] - first, 0)
    where, periods = [at[:0]], [at[:0]]
    if level == _LEAST:
        where.append(first[members > 1])
        periods.append(step[members > 1])
    ahead = 1
    while ahead < len(head):
        a = np.flatnonzero((name[:-ahead] == name[ahead:]) & (first[ahead:] - last[:-ahead] < 2 * size))
        if not len(a):
            break
        b = a + ahead
        gap, by = first[b] - last[a], np.maximum(step[a], step[b])
        more = np.minimum(members[a] + members[b] - 2, (2 * size - 1 - gap) // np.maximum(by, 1))
        of = np.repeat(np.arange(len(a)), more + 1)
        i = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
        where.append(last[a][of] - np.maximum(i - (members[b][of] - 1), 0) * by[of])
        periods.append(gap[of] + i * by[of])
        ahead += 1
    at, period = np.concatenate(where), np.concatenate(periods)
    keep = period >= (1 if level == _LEAST else size)
    at, period = at[keep], period[keep]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    seen = (period[1:] == period[:-1]) & (at[1:] <= at[:-1] + size)  # the same stretch
    new = np.concatenate(([True], ~seen))[: len(at)]
    return at[new], period[new]


def _extend(names: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the longest stretch around each position that keeps its period."""
    n = len(names[0])
    left, right = at.copy(), at + period
    for level in reversed(range(len(names))):
        name, size = names[level], 1 << level
        inside = right < n
        i, j = np.where(inside, right - period, 0), np.where(inside, right, 0)
        right += size * (inside & (name[i] >= 0) & (name[i] == name[j]))
        inside = left >= size
        i, j = np.where(inside, left - size, 0), np.where(inside, left - size + period, 0)
        left -= size * (inside & (name[i] >= 0) & (name[i] == name[j]))
    return left, right


def find_runs(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of a sequence of texts, ordered by start and period.

    `codes` numbers the words from 0; no number occurs in two texts. `ends` holds where each text ends.
    """
    n = len(codes)
    none = np.empty(0, np.int64)
    if n < SHORTEST:
        return none, none, none
    room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    names = [np.where(np.bincount(codes)[codes] > 1, codes, -1).astype(np.int32)]
    at = np.flatnonzero(names[0] >= 0)
    where, periods = [none], [none]
    while len(at):
        half, name = 1 << (len(names) - 1), names[-1]
        at = np.flatnonzero((name >= 0) & (room >= 2 * half))
        at = at[name[at + half] >= 0]
        name, at, group = _name(at, name[at].astype(np.int64) * n + name[at + half], n)
        if len(at):
            if len(names) >= _LEAST:
                i, d = _proposals(at, group, len(names))
                where.append(i)
                periods.append(d)
            names.append(name)
    at, period = np.concatenate(where), np.concatenate(periods)
    left, right = _extend(names, at, period)
    long = right - left >= np.maximum(SHORTEST, 2 * period)
    left, right, period = left[long], right[long], period[long]
    order = np.lexsort((period, right, left))
    left, right, period = left[order], right[order], period[order]
    new = np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))[: len(left)]
    left, right, period = left[new], right[new], period[new]
    order = np.lexsort((period, left))
    return left[order], (right - left)[order], period[order]


def _work(texts: list[bytes | None]) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """For some texts: the numbers of words, (start, length, period) of the runs and the collapsed texts."""
    split = [(t or b"").split() for t in texts]  # at the six ASCII white spaces
    sizes = [len(s) for s in split]
    codes = np.empty(sum(sizes), dtype=np.int64)
    at = used = 0
    for words in split:
        seen: dict[bytes, int] = {}
        codes[at : at + len(words)] = [seen.setdefault(w, len(seen)) for w in words]
        codes[at : at + len(words)] += used
        at, used = at + len(words), used + len(seen)
    ends = np.cumsum(sizes)
    start, length, period = find_runs(codes, ends)
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    cut = np.searchsorted(start, np.concatenate(([0], ends)))
    runs, collapsed = [], []
    for k, words in enumerate(split):
        base = int(ends[k]) - sizes[k]
        here = slice(cut[k], cut[k + 1])
        runs.append(np.stack((start[here] - base, length[here], period[here]), axis=1))
        if len(runs[-1]):
            words = [w for w, keep in zip(words, kept[base : base + sizes[k]].tolist()) if keep]
        collapsed.append(b" ".join(words))
    return sizes, runs, collapsed


_RUN = [pa.field(name, pa.int64()) for name in ("start", "length", "period")]


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "__text"):
        sizes, runs, collapsed = _work(batch.column(1).to_pylist())
        flat = np.concatenate(runs)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
        struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=_RUN)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, struct), pa.array(collapsed, pa.binary())],
            names=[batch.schema.names[0], "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: the id, n_words, runs (start, length, period; by start and period) and the collapsed text,
    in which every run is cut to its first period and words are joined by one space."""
    rows = docs.select(F.col(id_column), F.col(text_column).cast("binary").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    return rows.mapInArrow(_map, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic tail in the documents whose crc32 of the doc_id ends in 0.

    A document without a doc_id stays as it is.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    rounds = F.ceil((n - a) / p)
    i = lambda c: c.cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, i(a + 1), i(p)), i(rounds))), F.lit(1), i(n - a))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), i(a)), tail), " ")
    return docs.select("doc_id", F.when(h % 10 == 0, F.when(n > 0, changed).otherwise(F.col("text"))).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", top.alias("top"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.expr("1000 * top.length div -top.p").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
