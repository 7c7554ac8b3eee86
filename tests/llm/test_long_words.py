"""Shingles of texts with words longer than a block, and with any white space at a cut."""

import random
from collections import Counter

import numpy as np

from pitspark.llm import features, nearmatch
from tests.llm.test_dedup import near_classes, shingles


def test_long_words_are_one_word():
    rng = random.Random(3)
    blob = lambda n: "".join(rng.choices("abcXYZ", k=n))
    most = features.BLOCK - 2
    texts = ["small text", blob(600_000) + " a b c d", "a b c d e " + blob(2_000_000) + " f g", blob(most) + " q r s t", blob(most), blob(most + 1), "", blob(most) + "\x0b"]
    texts += [c.join(["word"] * 200_000 + ["x", "y", "z", "end"]) for c in " \t\n\x0b\x0c\r"] + [blob(3 * most) + "\r" + blob(2 * most) + " z", "last one"]
    got = nearmatch.shingle_sets(texts)
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert all((s == got[8]).all() for s in got[8:14])
    for shift in (1, 7, 300_000):  # the same words, cut elsewhere
        assert all(np.array_equal(a, b) for a, b in zip(got, nearmatch.shingle_sets([" " * shift + t for t in texts]), strict=True))


def test_near_groups_with_every_odd_row(tricky):
    got = nearmatch.near_groups(tricky).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(near_classes(tricky.select("doc_id", "text").collect()))
