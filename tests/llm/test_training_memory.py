"""What the driver holds while it trains."""

import tracemalloc
from collections import Counter

import numpy as np

from pitspark.llm import features, quality
from tests.llm.conftest import prose


def test_bags_are_small():
    texts = [prose(i, 400) + f" {i * 7919} né x{i}" for i in range(150)]
    quality._features("")  # builds the tables that all texts share
    tracemalloc.start()
    try:
        bags = [quality._features(t) for t in texts]
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    buckets = sum(len(b.buckets()) for b in bags)
    assert held < 5 * buckets + 1000 * len(texts)  # 12 bytes a bucket as 64-bit numbers and shares


def test_bags_hold_every_feature():
    for text in ["", "a", prose(3, 900), "x" * 70_000 + " y", "é ü 日本 " * 300]:
        want = Counter()
        for block in features.blocks([text]):
            for bucket, outside in features.grams(block, quality.SIZES, quality.BITS):
                want.update(np.delete(bucket, outside).tolist())
            want.update(features.bucket_of(features.words(block)[0], quality.BITS).tolist())
        bag = quality._features(text)
        at = sorted(want)
        assert bag.buckets().tolist() == at
        share = np.array([want[i] for i in at], dtype=np.float32) / np.float32(max(1, sum(want.values())))
        assert (bag.shares() == share).all() and bag.shares().dtype == np.float32
