"""Packing: tokens as the tokenizer makes them, places without gaps, capacities kept."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from pitspark.llm import packing
from pitspark.llm.packing import Capacity

pytest.importorskip("public_tokenizers")


def test_own_cutting_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    w = packing.WordTokenizer(packing.tokenizer_file(), remember=5)
    texts = ["İstanbul's CAFÉ don't WE'LL 123 x² ½ ǅ ſ !!'s''re", "<|endoftext|> a", "日本語", "áb", "", "   ", "\x85x\xa0y\x1cz", "ÀÉ ß STRAẞE", "ΑΣ Σας", "x" * 300, "'S 'T don'T a\r\nb"]
    assert w.encode(texts) == [np.asarray(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes() for s in texts]


def test_every_plain_character_inside_a_word():
    """Capitals whose lower case is outside the plain letters must not cut a word."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    w = packing.WordTokenizer(packing.tokenizer_file())
    texts = ["AZƏRBAYCAN", *[form.format(chr(c)) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)) for form in ("AB{}CD", "{}xy z", "xy{}", "{0}{0}")]]
    got = w.encode(texts)
    assert [s for s, ids in zip(texts, got, strict=True) if ids != np.asarray(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes()] == []


def test_pieces_and_places(tricky):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_file())
    docs = tricky.filter("doc_id is not null and doc_id not in (32, 40)")
    got = packing.pack(docs, packing.tokenizer_file()).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for doc_id, text in [(r.doc_id, r.text) for r in docs.collect()]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            own = ids[r.start : r.start + r.length]
            assert (r.piece, r.start, r.length) == (k, 2048 * k, len(own)) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        assert sum(r.length for r in by_doc[doc_id]) == len(ids)
    check_places([(r.sequence_id, r.offset, r.length) for r in got], Capacity())


def check_places(rows, capacity):
    seqs = defaultdict(list)
    for s, o, n in rows:
        seqs[s].append((o, n))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity.tokens and len(places) <= capacity.documents and sum(n * n for _, n in places) <= capacity.cost
    return len(seqs)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(64, 64, 4096), Capacity(64, 3, 4096), Capacity(64, 64, 700)])
def test_every_capacity_holds(rule, capacity):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, capacity.piece + 1, 3000)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.best_fit(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity, rule, weights=(1.0, 0.5, 0.5))
    rank = np.concatenate([np.arange(c) for c in counts])
    length = np.repeat(values, counts)
    seq, offset = plan.place(length, rank)
    assert check_places(zip(seq.tolist(), offset.tolist(), length.tolist(), strict=True), capacity) == plan.sequences


def test_norm_packs_like_one_item_at_a_time():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 65, 500).tolist(), reverse=True)
    room: list[int] = []
    for n in lengths:
        fit = [i for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= n
        else:
            room.append(64 - n)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.best_fit(dict(zip(values.tolist(), counts.tolist(), strict=True)), Capacity(64, 64, 4096), weights=(1.0, 0.0, 0.0))
    assert plan.sequences == len(room)


def test_empty_table(empty):
    assert packing.pack(empty, packing.tokenizer_file()).count() == 0
