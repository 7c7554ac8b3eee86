"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed into one table of learned vectors; a document is the mean of the vectors of all
its features, and a linear layer with softmax gives the classes. Stochastic gradient descent in numpy trains both on a
bounded sample of labelled documents (`rows`). Because the output layer is linear in the mean, each bucket's vector
reduces to one number per document score, so that scoring is a table lookup per feature.

Defined cases: a null or empty text has no word; its score comes from the bias and the empty word boundary alone. Without
labelled documents every score is 0.5. Repeated rows get equal scores. Extra columns are kept by `score`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.llm import features
from pitspark.llm.common import fold_of, fresh, labelled_sample, slices, table

BITS = 17
SIZES = (3, 4, 5)
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


@dataclass(frozen=True)
class Model:
    contrast: np.ndarray  # class 1 minus class 0, for each bucket
    bias: float


@dataclass(frozen=True)
class Bag:
    """Buckets of one text with the number of features in each, in about three bytes a bucket: the driver holds a bag for each
    text of the sample at once."""

    low: np.ndarray  # the lower 16 bits of each bucket, ascending
    above: np.ndarray  # where the next value of the upper bits begins
    count: np.ndarray
    total: np.float32

    def buckets(self) -> np.ndarray:
        at = self.low.astype(np.int64)
        for begin in self.above:
            at[begin:] += 1 << 16
        return at

    def shares(self) -> np.ndarray:
        """The share of each bucket among the text's features."""
        return self.count.astype(np.float32) / self.total


def _features(text: str) -> Bag:
    count = np.zeros(1 << BITS, dtype=np.float32)
    for block in features.blocks([text]):
        for bucket, outside in features.grams(block, SIZES, BITS):
            keep = np.ones(len(bucket), dtype=bool)
            keep[outside] = False
            count += np.bincount(bucket[keep], minlength=1 << BITS).astype(np.float32)
        count += np.bincount(features.bucket_of(features.words(block)[0], BITS), minlength=1 << BITS).astype(np.float32)
    at = np.flatnonzero(count)
    above = np.searchsorted(at, np.arange(1 << 16, 1 << BITS, 1 << 16))
    least = np.min_scalar_type(int(count.max()))
    return Bag(at.astype(np.uint16), above, count[at].astype(least), max(np.float32(1), count.sum()))


def fit(texts: list[str], classes: np.ndarray, dim: int = 12, epochs: int = 6, rate: float = 20.0, seed: int = 7) -> Model:
    """Plain SGD, one document at a time, with a step that falls linearly to zero."""
    if not len(texts):
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.log(np.bincount(classes, minlength=2) + 1.0).astype(np.float32)
    bags = [_features(t) for t in texts]
    steps, step = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            at, share = bags[i].buckets(), bags[i].shares()
            pace = 1 - step / steps
            step += 1
            held = vectors[at]
            mean = share @ held
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[classes[i]] -= 1  # gradient of the loss by the logits
            back = out @ p
            out -= 0.5 * pace * np.outer(mean, p)
            bias -= 0.05 * pace * p
            vectors[at] = held - (rate * pace) * share[:, None] * back[None, :]
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for block in features.blocks(texts):
        cuts = block.starts
        for bucket, outside in features.grams(block, SIZES, BITS):
            value = model.contrast[bucket].astype(np.float64)
            value[outside] = 0
            np.add.at(total, block.rows, np.add.reduceat(value, cuts))
        for size in SIZES:
            np.add.at(n, block.rows, np.maximum(0, block.lengths() - size + 1))
        hashes, starts, _ = features.words(block)
        piece = np.searchsorted(cuts, starts, side="right") - 1
        value = model.contrast[features.bucket_of(hashes, BITS)].astype(np.float64)
        np.add.at(total, block.rows, np.bincount(piece, weights=value, minlength=len(cuts)))
        np.add.at(n, block.rows, np.bincount(piece, minlength=len(cuts)))
    return 1 / (1 + np.exp(-(total / np.maximum(1, n) + model.bias)))


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> Model:
    """Fit on at most `rows` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, rows)
    return fit(sample["text"].tolist(), sample["target"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with the probability of class 1 as column `name` (with underscores in front if `docs` has one)."""
    name = fresh(docs.columns, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in slices(batches, "text"):
            p = probabilities(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns."""
    name = fresh(docs.columns, "score")
    return score(docs, train(docs, labels), name).filter(F.col(name) >= threshold).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
