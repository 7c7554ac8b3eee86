"""Hashed character n-grams and words of many texts at once, as numpy arrays.

Texts are cut into blocks of at most `BLOCK` characters, so memory does not depend on the length of a text. A text that
is longer is cut behind a white space; only a single word beyond `BLOCK` characters is cut inside, and the block with its
rest says so (`joins`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 19
SPACE = 32
WHITE = " \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 8, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS["up"] = _powers(_BASE)
        _POWERS["down"] = _powers(pow(_BASE, -1, 1 << 64))
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Block:
    """Characters of some pieces one after another. Each piece begins and ends with a space."""

    codes: np.ndarray
    rows: np.ndarray  # the text that each piece belongs to
    starts: np.ndarray
    ends: np.ndarray
    joins: bool = False  # the first word goes on with the last word of the block before

    def lengths(self) -> np.ndarray:
        return self.ends - self.starts


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """The pieces, each with whether it begins inside a word."""
    most = BLOCK - 2
    at, joins = 0, False
    while len(text) - at > most:
        cut = max(text.rfind(c, at, at + most) for c in WHITE) + 1
        inside = cut <= at
        cut = at + most if inside else cut
        yield text[at:cut], joins
        at, joins = cut, inside and text[cut] not in WHITE
    yield text[at:], joins


def blocks(texts: list[str], lower: bool = False) -> Iterator[Block]:
    held: list[str] = []
    rows: list[int] = []
    size, first = 0, False
    for row, text in enumerate(texts):
        for piece, joins in _pieces(text or ""):
            if size + len(piece) + 2 > BLOCK and held:
                yield _block(held, rows, lower, first)
                held, rows, size = [], [], 0
            first = first if held else joins  # a piece cut inside a word fills its block, so its rest begins the next one
            held.append(piece)
            rows.append(row)
            size += len(piece) + 2
    if held:
        yield _block(held, rows, lower, first)


def _block(pieces: list[str], rows: list[int], lower: bool, joins: bool) -> Block:
    codes = np.frombuffer((" " + "  ".join(pieces) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    codes[(codes >= 9) & (codes <= 13)] = SPACE
    if lower:
        upper = ((codes >= 65) & (codes <= 90)) | ((codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7))
        codes[upper] += 32
    ends = np.cumsum(np.fromiter((len(p) + 2 for p in pieces), dtype=np.int64, count=len(pieces)))
    return Block(codes, np.asarray(rows, dtype=np.int64), np.concatenate(([0], ends[:-1])), ends, joins)


def grams(block: Block, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n of `sizes`: the bucket of the n-gram that starts at each position, and the positions at which
    an n-gram would leave its piece."""
    c = block.codes.astype(np.uint64)
    h = c.copy()
    for n in range(1, max(sizes) + 1):
        if 1 < n <= len(c):
            h[: len(c) - n + 1] += c[n - 1 :] * np.uint64(pow(0x100000001B3, n - 1, 1 << 64))
        if n in sizes:
            bucket = ((h * np.uint64((int(_MIX) + 2 * n) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int32)
            outside = (block.ends[:, None] - np.arange(1, n)[None, :]) if n > 1 else np.empty((0, 0), dtype=np.int64)
            outside = outside[outside >= block.starts[:, None]] if n > 1 else np.empty(0, dtype=np.int64)
            yield bucket, outside


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of every run of characters without white space."""
    up, down = _tables()
    inside = np.concatenate(([0], (block.codes != SPACE).view(np.int8), [0])).astype(np.int8)
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(block.codes.astype(np.uint64) * up[: len(block.codes)], dtype=np.uint64)))
    return (prefix[ends] - prefix[starts]) * down[starts], starts, ends


def joined_hash(before: int, length: int, after: int) -> int:
    """The hash of a word from those of its first `length` characters and of the rest."""
    return (before + after * pow(_BASE, length, 1 << 64)) % (1 << 64)


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _MIX) >> np.uint64(64 - bits)).astype(np.int32)
