"""Best-fit packing of tokenised documents into sequences under several capacities.

A piece of a document is a vector: its tokens, one document, and its attention cost (tokens squared, as attention stays
inside a document). A sequence has a capacity in each of these dimensions. Pieces come in order of falling length; each
goes to the open sequence that fits in every dimension and is best by the rule: `norm` takes the smallest weighted norm
of what is left after the piece, `dot` the largest weighted dot product of the piece and what is left; a new sequence
opens only if none fits.

Pieces of one length are equal vectors, so the choice is made for runs of equal sequences at once: the plan depends on
the histogram of lengths, which has at most `Capacity.tokens` rows, whatever the number of documents. The plan gives to
each length a list of rank intervals; a row finds its place from its rank among the pieces of its length by arithmetic.
Ranks come from a range partitioning by (length, doc_id, piece): the counts by partition and length have at most
partitions + `Capacity.tokens` rows.

Defined cases: a null or empty text is one piece that holds the end id alone. Repeated rows are packed as often as they
occur. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.llm.common import stored, table

END = b"\0\0\0\0"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. The default document count and cost bind only together with other piece lengths."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048

    @property
    def piece(self) -> int:
        """The longest piece that fits a sequence."""
        return min(self.tokens, math.isqrt(self.cost))

    def vector(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], dtype=np.int64)

    def whole(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.cost], dtype=np.int64)


class WordTokenizer:
    """Ids of a lower-casing word BPE. Pre-tokens are encoded once and remembered, up to `remember` of them.

    Texts of plain Latin letters are cut into pre-tokens here; any other text, and one that may hold a special token,
    goes to the tokenizer as it is.
    """

    def __init__(self, path: str, remember: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.remember = remember
        latin = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250))]
        plain = [c for c in latin if c.lower() in latin]  # some capitals lower to letters of other ranges, or to two characters
        kind = lambda k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k)
        letters, numbers = kind("L"), kind("N")
        self.plain = re.compile("[" + "".join(map(re.escape, plain)) + "]*")
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.inner.encode_batch(texts, add_special_tokens=False)]

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, encoded in one text: a space ends every pre-token."""
        found = self.inner.encode(" ".join(words), add_special_tokens=False)
        ids = np.asarray(found.ids, dtype="<u4").tobytes()
        cuts = [0, *(4 * (np.flatnonzero(np.diff(found.word_ids)) + 1)).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if len(cuts) == len(words) + 1 else self._ids(words)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        words: list[list[str] | None] = []
        unknown: dict[str, bytes] = {}
        for t in texts:
            if "<|" in t or not self.plain.fullmatch(t):
                words.append(None)
                continue
            found = self.cut.findall(t.lower())
            words.append(found)
            unknown.update((w, b"") for w in set(found).difference(self.known))
        new = list(unknown)
        for at in range(0, len(new), 4096):
            unknown.update(zip(new[at : at + 4096], self._ids_of_words(new[at : at + 4096]), strict=True))
        room = self.remember - len(self.known)
        self.known.update((w, unknown[w]) for w in new[: max(0, room)])
        left = {w: unknown[w] for w in new[max(0, room) :]}
        known = self.known
        get = known.__getitem__ if not left else lambda w: known.get(w) or left[w]
        return [self._ids([t])[0] if w is None else b"".join(map(get, w)) for t, w in zip(texts, words, strict=True)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file; kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _groups(texts: list[str], characters: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= characters:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def pieces(docs: DataFrame, capacity: Capacity, path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the documents' ids, each ended by id 0, cut to fit."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    )
    most = capacity.piece

    def run(batches):
        words = tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            for begin, group in _groups(texts):
                for i, ids in enumerate(words.encode(group), begin):
                    ids += END
                    n = len(ids) // 4
                    for k, at in enumerate(range(0, n, most)):
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(min(most, n - at))
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + most)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[f.name for f in schema],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Plan:
    """Rank intervals of the lengths, ordered by (length, first rank)."""

    length: np.ndarray
    first_rank: np.ndarray
    per_sequence: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 44) + self.first_rank
        at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
        own = rank - self.first_rank[at]
        return self.first_sequence[at] + own // self.per_sequence[at], self.offset[at] + own % self.per_sequence[at] * length


def best_fit(counts: dict[int, int], capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)) -> Plan:
    """Pack `counts[length]` pieces of each length.

    Open sequences are kept as runs with consecutive numbers that have equal room. A length moves whole runs, and splits
    at most one run into three, so there are at most about three runs for each length.
    """
    whole = capacity.whole()
    w = np.asarray(weights) / whole.astype(float) ** 2
    room = np.empty((0, 3), dtype=np.int64)
    low, high, filled = (np.empty(0, dtype=np.int64) for _ in range(3))
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        item, left, rank = capacity.vector(length), counts[length], 0
        if (item > whole).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((room >= item).all(axis=1))
            if not len(fits):
                most = int((whole // item).min())
                n = -(-left // most)
                room, low, high, filled = np.vstack([room, whole]), np.append(low, opened), np.append(high, opened + n), np.append(filled, 0)
                opened += n
                continue
            if rule == "norm":
                score = ((room[fits] - item).astype(float) ** 2) @ w
                s = int(fits[np.lexsort((low[fits], score))[0]])
                most = int((room[s] // item).min())
            elif rule == "dot":
                score = (room[fits] * item).astype(float) @ w
                s = int(fits[np.lexsort((low[fits], -score))[0]])
                most = 1
            else:
                raise ValueError(rule)
            each = min(most, left)
            n = min(int(high[s] - low[s]), left // each)
            out.append((length, rank, each, int(low[s]), int(filled[s])))
            rank += each * n
            left -= each * n
            if n < high[s] - low[s]:  # the rest of the run stays as it is
                room, low, high, filled = np.vstack([room, room[s]]), np.append(low, low[s] + n), np.append(high, high[s]), np.append(filled, filled[s])
                high[s] = low[s] + n
            room[s] = room[s] - each * item
            filled[s] += each * length
        alive = room[:, 0] >= 1
        room, low, high, filled = room[alive], low[alive], high[alive], filled[alive]
    out.sort()
    cols = np.array(out, dtype=np.int64).reshape(-1, 5).T
    return Plan(*cols, sequences=opened)


def pack(docs: DataFrame, path: str, capacity: Capacity = Capacity(), rule: str = "norm") -> DataFrame:
    """Every piece with its sequence and its place there; `path` is the tokenizer's file."""
    cut = stored(pieces(docs, capacity, path))
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = stored(cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    stats = ranked.groupBy(part.alias("part"), "length").agg(F.min("at").alias("first"), F.count("*").alias("n")).toPandas().sort_values(["length", "part"])
    before = (stats.groupby("length")["n"].cumsum() - stats["n"]).to_numpy().astype(np.int64)
    plan = best_fit({int(k): int(v) for k, v in stats.groupby("length")["n"].sum().items()}, capacity, rule)
    stat_key = (stats["length"].to_numpy(dtype=np.int64) << 31) + stats["part"].to_numpy(dtype=np.int64)
    shift = before - stats["first"].to_numpy(dtype=np.int64)
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("at").to_numpy()
            rank = at + shift[np.searchsorted(stat_key, (length << 31) + (at >> 33))]
            sequence, offset = plan.place(length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[f.name for f in schema])

    return ranked.mapInArrow(run, schema)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())
