"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Buckets of hashed n-grams are weighted by how many training documents have them, counted over all documents outside the
held-out fold; term frequencies are shares of a text's n-grams. The weights are trained with follow-the-regularised-
leader (per-coordinate steps, L1 and L2 penalties) on a bounded sample (`rows`), a part of which is set aside to fit
the temperature of the softmax.

Defined cases: a text that is null or has no letter is `und` with score 1; one with letters always gets a learned
language. Rows with a null `lang` teach nothing. Without training rows every text is `und` with score 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.llm import features
from pitspark.llm.common import fold_of, table

BITS = 16
SIZES = (1, 2, 3)
FOLDS, HELD_OUT = 3, 1
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    names: list[str]
    weights: np.ndarray  # bucket x language, times the bucket's idf
    bias: np.ndarray
    temperature: float


def _marks(texts: list[str], at_once: int = 32) -> np.ndarray:
    """In how many of the texts each bucket occurs."""
    found = np.zeros(1 << BITS, dtype=np.int64)
    for begin in range(0, len(texts), at_once):
        part = texts[begin : begin + at_once]
        seen = np.zeros((len(part), 1 << BITS), dtype=np.uint8)
        flat = seen.ravel()
        for block in features.blocks(part, lower=True):
            base = np.repeat(block.rows.astype(np.int32) << BITS, block.lengths())
            for bucket, outside in features.grams(block, SIZES, BITS):
                where = base + bucket
                if len(outside):
                    where = np.delete(where, outside)
                flat[where] = 1
        found += seen.sum(axis=0, dtype=np.int64)
    return found


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each bucket, documents), over all rows of `docs`. A task sends one row for each bucket it met,
    so the shuffle grows with tasks, not with texts; the result has 2**BITS rows."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("df", T.LongType())])

    def run(batches):
        total, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            total += _marks(texts)
            n += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["bucket", "df"])

    got = docs.select(F.coalesce(F.col("text"), F.lit(""))).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(1 << BITS, dtype=np.int64)
    real = got[got["bucket"] >= 0]
    out[real["bucket"].to_numpy(dtype=np.int64)] = real["df"].to_numpy(dtype=np.int64)
    return out, int(got.loc[got["bucket"] < 0, "df"].sum())


def _bag(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.zeros(1 << BITS, dtype=np.int64)
    for block in features.blocks([text], lower=True):
        for bucket, outside in features.grams(block, SIZES, BITS):
            count += np.bincount(np.delete(bucket, outside) if len(outside) else bucket, minlength=1 << BITS)
    at = np.flatnonzero(count)
    return at, count[at] / max(1, count.sum()) * idf[at]


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], idf: np.ndarray, epochs: int = 2, alpha: float = 4.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, seed: int = 11) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    index = {n: i for i, n in enumerate(names)}
    y = np.array([index[x] for x in langs])
    k = len(names)
    z = np.zeros((1 << BITS, k))
    g2 = np.zeros((1 << BITS, k))
    prior = np.log(np.bincount(y, minlength=k) + 1.0)
    bias = prior - prior.mean()

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(g2[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    aside = set(order[: max(1, len(texts) // 5)].tolist()) if len(texts) >= 10 else set()
    bags = [_bag(t, idf) for t in texts]
    learn = np.array([i for i in range(len(texts)) if i not in aside])
    for _ in range(epochs):
        for i in rng.permutation(learn):
            at, value = bags[i]
            if not len(at):
                continue
            w = weights(at)
            p = _softmax(value @ w + bias)
            p[y[i]] -= 1
            g = value[:, None] * p[None, :]
            root = np.sqrt(g2[at])
            g2[at] += g * g
            z[at] += g - (np.sqrt(g2[at]) - root) / alpha * w
    every = weights(np.arange(1 << BITS))
    held = [i for i in sorted(aside)] or list(range(len(texts)))
    logits = np.array([bags[i][1] @ every[bags[i][0]] + bias for i in held])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    loss = [-np.mean(np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(held)), y[held]]))) for t in grid]
    return Model(names, (every * idf[:, None]).astype(np.float32), bias, float(grid[int(np.argmin(loss))]))


def train(docs: DataFrame, rows: int = 4000) -> Model:
    """`docs` has doc_id, text and lang. Document frequencies cover all its training rows, the weights at most `rows`."""
    own = docs.filter((fold_of(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    df, n = document_frequencies(own)
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "lang").limit(rows)
    ids = sample.groupBy("doc_id").agg(F.min("lang").alias("label"))
    found = own.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").toPandas()
    found = found.sort_values(["doc_id", "text"], kind="stable")
    return fit(found["text"].tolist(), found["label"].tolist(), np.log((1 + n) / (1 + df)) + 1)


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    k = len(model.names)
    total, n = np.zeros((len(texts), k)), np.zeros(len(texts))
    for block in features.blocks(texts, lower=True):
        for bucket, outside in features.grams(block, SIZES, BITS):
            for j in range(k):
                value = np.ascontiguousarray(model.weights[:, j])[bucket].astype(np.float64)
                value[outside] = 0
                np.add.at(total[:, j], block.rows, np.add.reduceat(value, block.starts))
        for size in SIZES:
            np.add.at(n, block.rows, np.maximum(0, block.lengths() - size + 1))
    return _softmax((total / np.maximum(1, n)[:, None] + model.bias) / model.temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = np.array([bool(t and LETTER.search(t)) for t in texts], dtype=bool)
            if not model.names:
                names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            else:
                p = probabilities(model, texts)
                names = [model.names[j] if k else UNDETERMINED for j, k in zip(p.argmax(axis=1), known, strict=True)]
                score = np.where(known, p.max(axis=1), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
