"""Removal of repeated byte strings: bucket-pointer refinement over sampled suffixes.

A byte goes if a string of `DEPTH` bytes that covers it also starts in a document with a smaller doc_id. Suffixes matter
only to depth `DEPTH`, and their order doesn't matter, only which are equal; so buckets are named by 64-bit identifiers
in place of ranks. The identifier of a longer string is made of those of its first part and of the part at a later
offset, and is used again in the next step: 4 bytes, 8, 16, 20 (the q-gram), 40, 50.

1. Initial buckets: q-grams. Of the q-grams inside each window of `DEPTH` bytes the one with the smallest identifier is
   its anchor, so equal windows have equal anchors and a sixteenth of all suffixes names all windows. Buckets that one
   document has alone are final.
2. Refinement of the others by the identifiers of the later offsets up to the end of the stretch of windows that share
   the anchor. A member whose whole stretch is in a smaller document is done.
3. Refinement of buckets that still hold different stretches by the identifiers of each single window.

Documents are worked on in batches of rows that follow one another. A batch sends each identifier once, with its
smallest doc_id, to the lane that the identifier belongs to; a lane sorts what it gets and answers each batch. So a
string in a third of all documents costs one entry for each batch, and every batch and lane has a bounded size. Only
stretches in shared buckets are kept for the later steps. A batch sends at most `fan` messages a step: with more lanes, they
go to ranges of lanes, and a task for a range and a pool of batches deals them on, with one message for a lane and pool.

Defined cases: a null text is empty. Documents below `DEPTH` bytes lose nothing. Rows with one doc_id do not take from
each other. A null doc_id counts as larger than any other. Different strings get one identifier with a probability of
about (identifiers compared)**2 / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.llm.common import drop_stored, keyed_texts, stored, stored_at, table

Q, DEPTH = 20, 50
PIECE = 1 << 20
LAST = (1 << 63) - 1
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _join(first: np.ndarray, later: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers of strings from those of their first part and of the part `offset` bytes later."""
    n = len(later) - offset
    x = first[:n] * _K1 + (later[offset:] ^ (later[offset:] >> np.uint64(32))) * _K2
    x ^= x >> np.uint64(29)
    return x * _K3


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the Q bytes and of the `DEPTH` bytes from each place on. `data` has at least `DEPTH` bytes."""
    c = data.astype(np.uint64)
    four = c[:-3] | (c[1:-2] << np.uint64(8)) | (c[2:-1] << np.uint64(16)) | (c[3:] << np.uint64(24))
    eight = _join(four, four, 4)
    sixteen = _join(eight, eight, 8)
    gram = _join(sixteen, four, 16)
    forty = _join(gram, gram, 20)
    return gram, _join(forty, gram, 30)


def anchors(gram: np.ndarray) -> np.ndarray:
    """The smallest q-gram identifier inside each window."""
    low, size, want = gram, 1, DEPTH - Q + 1
    while 2 * size <= want:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = want - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


@dataclass
class Stretches:
    """Runs of windows with one anchor in the texts of a buffer: first and next window, text, anchor; and per window ids."""

    first: np.ndarray
    end: np.ndarray
    row: np.ndarray
    anchor: np.ndarray
    window: np.ndarray
    offset: np.ndarray  # of the buffer's place 0 in the text of each stretch
    data: np.ndarray


def _buffers(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several pieces, their starts, texts and places there. Pieces of one text overlap by DEPTH - 1 bytes."""
    held, rows, places, size = [], [], [], 0

    def out():
        lengths = np.array([len(h) for h in held])
        return np.concatenate(held), np.cumsum(lengths) - lengths, np.array(rows), np.array(places)

    for row, text in enumerate(texts):
        data = np.frombuffer(text, dtype=np.uint8)
        for at in range(0, max(1, len(data) - DEPTH + 1), PIECE - DEPTH + 1):
            part = data[at : at + PIECE]
            if len(part) < DEPTH:
                continue
            if held and size + len(part) > PIECE:
                yield out()
                held, rows, places, size = [], [], [], 0
            held.append(part)
            rows.append(row)
            places.append(at)
            size += len(part)
    if held:
        yield out()


def stretches(texts: list) -> Iterator[Stretches]:
    for data, starts, rows, places in _buffers(texts):
        gram, window = identifiers(data)
        low = anchors(gram)
        ends = np.append(starts[1:], len(data)) - DEPTH + 1  # the next window of each piece
        change = np.concatenate(([True], low[1:] != low[:-1]))
        change[starts] = True
        change[ends[:-1]] = True
        first = np.flatnonzero(change)
        piece = np.searchsorted(starts, first, side="right") - 1
        real = first < ends[piece]
        end = np.append(first[1:], len(low))
        first, end, piece = first[real], end[real], piece[real]
        yield Stretches(first, end, rows[piece], low[first], window, places[piece] - starts[piece], data)


def _name(s: Stretches, pick: np.ndarray) -> np.ndarray:
    """Identifiers of whole stretches, from those of their windows by place."""
    first, length = s.first[pick], s.end[pick] - s.first[pick]
    if not len(first):
        return np.empty(0, np.uint64)
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    weight = (step.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _K1
    weight ^= weight >> np.uint64(31)
    x = s.window[np.repeat(first, length) + step] * (weight | np.uint64(1))
    x = np.add.reduceat(x ^ (x >> np.uint64(30)), np.cumsum(length) - length)
    return _join(x, length.astype(np.uint64), 0)


def _smallest(names: np.ndarray, docs: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct names in order, with the smallest doc of each, whether other docs have it, and the values that come with it."""
    order = np.lexsort((docs, names))
    names, docs = names[order], docs[order]
    at = _changes(names)
    return names[at], docs[at], docs[at] != docs[np.append(at[1:], len(names)) - 1] if len(at) else np.empty(0, bool), *(m[order][at] for m in more)


def _changes(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def _lane_of(names: np.ndarray, lanes: int) -> np.ndarray:
    """Anchors are the smallest of many identifiers, so lanes are ranges of mixed names, not of names."""
    x = names * _K2
    x = (x ^ (x >> np.uint64(31))) * _K1
    return (((x >> np.uint64(32)) * np.uint64(lanes)) >> np.uint64(32)).astype(np.int32)


_SENT = T.StructType([T.StructField("lane", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("names", T.BinaryType()), T.StructField("more", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("owner", T.BinaryType())])
_ANSWER = T.StructType([T.StructField("batch", T.LongType()), T.StructField("lane", T.IntegerType()), T.StructField("step", T.IntegerType()), T.StructField("names", T.BinaryType()), T.StructField("docs", T.BinaryType()), T.StructField("shared", T.BinaryType()), T.StructField("owner", T.BinaryType())])


def _arrow(schema: T.StructType):
    kinds = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BinaryType: pa.binary()}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in schema])


def _rows(rows: list[tuple], schema: T.StructType, kind=pa.RecordBatch):
    s = _arrow(schema)
    return kind.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(s)], schema=s)


def _send(batch: int, lanes: int, names: np.ndarray, more: np.ndarray, docs: np.ndarray, by: np.ndarray | None = None, width: int = 1, owner: np.ndarray | None = None) -> list[tuple]:
    """Rows for the lanes, or ranges of `width` lanes, of `by` (the names themselves if none). `owner`: the batch of each name of a pool."""
    if not len(names):
        return []
    lane = _lane_of(names if by is None else by, lanes) // width
    place = lane - lane.min()
    order = np.argsort(place.astype(np.uint16) if place.max() < 1 << 16 else place, kind="stable")  # 16 bits are sorted by radix
    lane, names, more, docs = lane[order], names[order], more[order], docs[order]
    at = _changes(lane)
    cuts = zip(lane[at].tolist(), at.tolist(), [*at[1:].tolist(), len(lane)], strict=True)
    owner = np.empty(0, np.int64) if owner is None else owner[order]
    return [(i, batch, names[a:b].tobytes(), more[a:b].tobytes(), docs[a:b].tobytes(), owner[a:b].tobytes()) for i, a, b in cuts]


def _column(table: pa.Table, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a binary column in one, and the length of each."""
    parts = table[name].to_pylist()
    return np.frombuffer(b"".join(parts), dtype=dtype), np.array([len(p) for p in parts], dtype=np.int64) // np.dtype(dtype).itemsize


def _answer(sent: pa.Table, step: int, keep: np.ndarray, names: np.ndarray, docs: np.ndarray | None = None, shared: np.ndarray | None = None) -> pa.Table:
    """To each message of a lane, the names of it that `keep` has, with their values. Names lie in the order of the messages."""
    _, size = _column(sent, "names", np.uint64)
    owner, _ = _column(sent, "owner", np.int64)
    kept = np.flatnonzero(keep)
    cuts = np.searchsorted(kept, np.append(0, np.cumsum(size))).tolist()
    names, docs, shared, owner = (x[kept] if x is not None and len(x) else np.empty(0, np.uint8) for x in (names, docs, shared, owner))
    rows = zip(sent["batch"].to_pylist(), sent["lane"].to_pylist(), cuts, cuts[1:], strict=False)
    return _rows([(batch, lane, step, names[a:b].tobytes(), docs[a:b].tobytes(), shared[a:b].tobytes(), owner[a:b].tobytes()) for batch, lane, a, b in rows if b > a], _ANSWER, pa.Table)


def _deal_on(lanes: int, by_more: bool):
    """Messages of a pool of batches to a range of lanes become one message to each lane."""

    def run(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        names, size = _column(sent, "names", np.uint64)
        more, _ = _column(sent, "more", np.uint64 if by_more else np.uint8)
        docs, _ = _column(sent, "docs", np.int64)
        owner = np.repeat(sent["batch"].to_numpy(), size)
        return _rows(_send(key[0].as_py(), lanes, names, more, docs, more if by_more else None, owner=owner), _SENT, pa.Table)

    return run


def _hand_back(answers: pa.Table) -> pa.Table:
    """Answers to a pool of batches from a range of lanes become one answer to each batch."""
    owner, _ = _column(answers, "owner", np.int64)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    values = [_column(answers, c, t)[0] for c, t in (("names", np.uint64), ("docs", np.int64), ("shared", np.uint8))]
    names, docs, shared = (x[order] if len(x) else x for x in values)
    at = _changes(owner)
    step = answers["step"][0].as_py()
    cuts = zip(owner[at].tolist(), at.tolist(), [*at[1:].tolist(), len(owner)], strict=True)
    return _rows([(batch, 0, step, names[a:b].tobytes(), docs[a:b].tobytes(), shared[a:b].tobytes(), b"") for batch, a, b in cuts], _ANSWER, pa.Table)


def _exchange(sent: DataFrame, answer, lanes: int, width: int, by_more: bool = False) -> tuple[DataFrame, str]:
    """The lanes' answers to the messages of all batches, stored."""
    if width == 1:
        return stored_at(sent.groupBy("lane").applyInArrow(answer, _ANSWER))
    pooled = sent.withColumn("pool", F.pmod(F.xxhash64("batch"), F.lit(width).cast("long")))
    answers = pooled.groupBy("pool", "lane").applyInArrow(_deal_on(lanes, by_more), _SENT).groupBy("lane").applyInArrow(answer, _ANSWER)
    ranged = answers.withColumn("range", F.floor(F.col("lane") / width))
    return stored_at(ranged.groupBy("batch", "range").applyInArrow(_hand_back, _ANSWER))


def _groups_of(batches, lists: list[str]) -> Iterator[tuple[int, list[list]]]:
    """The rows of record batches by runs of the column `batch`."""
    for batch in batches:
        ids = batch.column("batch").to_numpy()
        if not len(ids):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            yield int(ids[a]), [part.column(c).to_pylist() for c in lists]


# ---- step 1: q-gram buckets


def _gram_rows(lanes: int, width: int):
    def run(batches):
        for batch, (texts,) in _groups_of(batches, ["data"]):
            found, rows = [], []
            for s in stretches(texts):
                found.append(s.anchor)
                rows.append(s.row)
            if not found:
                continue
            pairs = np.unique(np.rec.fromarrays([np.concatenate(found), np.concatenate(rows)], names="name,row"))
            names = pairs["name"]
            at = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            several = (np.diff(np.append(at, len(names))) > 1).astype(np.int64)
            yield _rows(_send(batch, lanes, names[at], np.zeros(len(at), np.uint8), several, width=width), _SENT)

    return run


def _shared_grams(sent: pa.Table) -> pa.Table:
    """Answer each batch which of its q-gram buckets another document has, too."""
    names, _ = _column(sent, "names", np.uint64)
    several, _ = _column(sent, "docs", np.int64)
    order = np.argsort(names, kind="stable")
    at = _changes(names[order])
    size = np.diff(np.append(at, len(names)))
    shared = np.empty(len(names), bool)
    shared[order] = np.repeat((size > 1) | (np.maximum.reduceat(several[order], at) > 0), size)
    return _answer(sent, 1, shared, names)


_RUN = T.StructType([T.StructField("batch", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("start", T.LongType()), T.StructField("data", T.BinaryType())])


def _shared_runs(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The parts of the texts whose windows have a shared anchor."""
    names = np.unique(_column(answers, "names", np.uint64)[0])
    out = []
    if len(names) and texts.num_rows:
        rid, doc, data = (texts[c].to_pylist() for c in ("rid", "doc", "data"))
        for s in stretches(data):
            at = np.minimum(np.searchsorted(names, s.anchor), len(names) - 1)
            hit = np.flatnonzero(names[at] == s.anchor)
            if not len(hit):
                continue
            new = np.concatenate(([True], (s.first[hit][1:] != s.end[hit][:-1]) | (s.row[hit][1:] != s.row[hit][:-1]) | (s.offset[hit][1:] != s.offset[hit][:-1])))
            a = hit[new]
            b = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                low, high = int(s.first[i]), int(s.end[j]) + DEPTH - 1
                r = int(s.row[i])
                out.append((key[0].as_py(), rid[r], doc[r], low + int(s.offset[i]), s.data[low:high].tobytes()))
    return _rows(out, _RUN, pa.Table)


# ---- step 2: whole stretches


def _stretch_rows(lanes: int, width: int):
    def run(batches):
        for batch, (data, docs) in _groups_of(batches, ["data", "doc"]):
            doc = np.asarray(docs, dtype=np.int64)
            names, own, anchor = [], [], []
            for s in stretches(data):
                names.append(_name(s, np.arange(len(s.first))))
                own.append(doc[s.row])
                anchor.append(s.anchor)
            if names:
                name, least, _, bucket = _smallest(np.concatenate(names), np.concatenate(own), np.concatenate(anchor))
                yield _rows(_send(batch, lanes, name, bucket, least, by=bucket, width=width), _SENT)

    return run


def _refined(sent: pa.Table) -> pa.Table:
    """Answer each batch, for each of its stretches, the smallest document and whether the bucket has other stretches."""
    names, _ = _column(sent, "names", np.uint64)
    bucket, _ = _column(sent, "more", np.uint64)
    docs, _ = _column(sent, "docs", np.int64)
    order = np.lexsort((docs, names, bucket))
    n, b = names[order], bucket[order]
    new_b = np.concatenate(([True], b[1:] != b[:-1]))
    new = new_b | np.concatenate(([True], n[1:] != n[:-1]))
    least, several = np.empty(len(n), np.int64), np.empty(len(n), np.uint8)
    least[order] = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_b))
    several[order] = (kinds > 1)[np.cumsum(new_b) - 1]
    return _answer(sent, 2, np.ones(len(names), bool), names, least, several)


def _answers(answers: pa.Table, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = answers.filter(pa.compute.equal(answers["step"], step))
    names, docs, shared = _column(part, "names", np.uint64)[0], _column(part, "docs", np.int64)[0], _column(part, "shared", np.uint8)[0]
    order = np.argsort(names, kind="stable")
    return names[order], docs[order], shared[order] if len(shared) else shared


def _look_up(names: np.ndarray, values: np.ndarray, ask: np.ndarray, default) -> np.ndarray:
    if not len(names):
        return np.full(len(ask), default, dtype=values.dtype)
    at = np.minimum(np.searchsorted(names, ask), len(names) - 1)
    return np.where(names[at] == ask, values[at], default)


def _open_windows(s: Stretches, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of some stretches, and the stretch of each."""
    length = s.end[pick] - s.first[pick]
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(s.first[pick], length) + step, np.repeat(pick, length)


# ---- step 3: single windows


def _window_rows(lanes: int, width: int):
    def run(key, runs: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        name, least, several = _answers(answers, 2)
        doc = runs["doc"].to_numpy()
        names, docs = [], []
        for s in stretches(runs["data"].to_pylist()):
            own = _name(s, np.arange(len(s.first)))
            still = (_look_up(name, least, own, LAST) >= doc[s.row]) & (_look_up(name, several, own, 0) > 0)
            at, stretch = _open_windows(s, np.flatnonzero(still))
            names.append(s.window[at])
            docs.append(doc[s.row[stretch]])
        if names:
            w, d, others = _smallest(np.concatenate(names), np.concatenate(docs))
            out = _send(key[0].as_py(), lanes, w, others.astype(np.uint8), d, width=width)
        return _rows(out, _SENT, pa.Table)

    return run


def _equal_windows(sent: pa.Table) -> pa.Table:
    """Answer each batch the smallest document of those of its windows that a smaller document has."""
    names, _ = _column(sent, "names", np.uint64)
    others, _ = _column(sent, "more", np.uint8)
    docs, _ = _column(sent, "docs", np.int64)
    order = np.lexsort((docs, names))
    at = _changes(names[order])
    least = np.empty(len(names), np.int64)
    least[order] = np.repeat(docs[order][at], np.diff(np.append(at, len(names))))
    # if a batch's only document with a window is the smallest of all, no answer says the same
    return _answer(sent, 3, (least < docs) | (others > 0), names, least)


_CUT = T.StructType([T.StructField("rid", T.LongType()), T.StructField("starts", T.BinaryType()), T.StructField("ends", T.BinaryType())])


def _merge_windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the windows starting at `at` cover."""
    at = np.unique(at)
    new = np.concatenate(([True], at[1:] > at[:-1] + DEPTH))
    last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return at[new], at[last] + DEPTH


def _cuts(key, runs: pa.Table, answers: pa.Table) -> pa.Table:
    """The byte runs that each document of a batch loses."""
    name, least, _ = _answers(answers, 2)
    wname, wleast, _ = _answers(answers, 3)
    doc, rid, start = (runs[c].to_numpy() for c in ("doc", "rid", "start"))
    place, owner = [], []
    for s in stretches(runs["data"].to_pylist()):
        own = doc[s.row]
        gone = _look_up(name, least, _name(s, np.arange(len(s.first))), LAST) < own
        at, stretch = _open_windows(s, np.flatnonzero(gone))
        more, other = _open_windows(s, np.flatnonzero(~gone))
        hit = _look_up(wname, wleast, s.window[more], LAST) < own[other]
        at, stretch = np.concatenate([at, more[hit]]), np.concatenate([stretch, other[hit]])
        place.append(at + s.offset[stretch] + start[s.row[stretch]])
        owner.append(rid[s.row[stretch]])
    out = []
    if place:
        p, o = np.concatenate(place), np.concatenate(owner)
        order = np.argsort(o, kind="stable")
        p, o = p[order], o[order]
        cuts = [0, *(np.flatnonzero(np.diff(o)) + 1).tolist(), len(o)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                x, y = _merge_windows(p[a:b])
                out.append((int(o[a]), x.astype(np.int64).tobytes(), y.astype(np.int64).tobytes()))
    return _rows(out, _CUT, pa.Table)


def cut_spans(texts: DataFrame, batch_bytes: int = 4 << 20, lane_names: int = 400_000, fan: int = 2048) -> DataFrame:
    """(rid, starts, ends): the byte runs to remove, as arrays of 64-bit integers. `texts` has rid, doc_id and text.

    `batch_bytes` is about how much text a batch holds, `lane_names` about how many identifiers a lane gets, `fan` to how many
    lanes or ranges of lanes a batch sends.
    """
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    per_batch = max(1, batch_bytes * max(1, rows) // max(1, size))
    lanes = max(1, size // (16 * lane_names))
    width = -(-lanes // fan)
    keyed = texts.select(F.shiftright("rid", per_batch.bit_length() - 1).alias("batch"), "rid", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("text").cast("binary").alias("data"))
    grams, at_grams = _exchange(keyed.select("batch", "data").mapInArrow(_gram_rows(lanes, width), _SENT), _shared_grams, lanes, width)
    runs, at_runs = stored_at(keyed.groupBy("batch").cogroup(grams.groupBy("batch")).applyInArrow(_shared_runs, _RUN))
    drop_stored(texts.sparkSession, at_grams)
    whole, at_whole = _exchange(runs.mapInArrow(_stretch_rows(lanes, width), _SENT), _refined, lanes, width, by_more=True)
    single = runs.groupBy("batch").cogroup(whole.groupBy("batch")).applyInArrow(_window_rows(lanes, width), _SENT)
    single, at_single = _exchange(single, _equal_windows, lanes, width)
    cuts = stored(runs.groupBy("batch").cogroup(whole.unionByName(single).groupBy("batch")).applyInArrow(_cuts, _CUT))
    for at in (at_runs, at_whole, at_single):
        drop_stored(texts.sparkSession, at)
    return cuts


def strip(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """For each row: rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256, and, if asked for, the bytes that are left."""
    texts = keyed_texts(docs)
    cuts = cut_spans(texts)
    fields = [T.StructField("rid", T.LongType()), docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + ([T.StructField("kept", T.BinaryType())] if with_text else []))

    def run(batches):
        for batch in batches:
            out = []
            for data, a, b in zip(batch.column("data").to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                starts, ends = np.frombuffer(a or b"", dtype=np.int64), np.frombuffer(b or b"", dtype=np.int64)
                kept = b"".join(data[x:y] for x, y in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))
                out.append((len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 if with_text else 4])]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), *cols], names=[f.name for f in schema])

    joined = texts.select("rid", "doc_id", F.col("text").cast("binary").alias("data")).join(cuts, "rid", "left")
    return joined.select("rid", "doc_id", "data", "starts", "ends").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return strip(table(spark, sf_dir, "documents")).drop("rid")
