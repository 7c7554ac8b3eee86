"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text is cut into overlapping windows of words. A word enters as a learned vector of its hash and three numbers:
how strongly the word itself, its character n-grams on average, and the strongest of these go with toxic training
documents (the log odds that are sure: beyond 2.5 standard errors). Two gated recurrent layers read a window in both directions, attention weighs the words, and a logistic
unit gives the window's logit. A document has the largest logit of its windows, calibrated on documents set aside.

Training is numpy on the driver over a bounded sample of labelled documents (`rows`). A toxic document teaches by its
most suspicious window, a clean one by its most suspicious and one other. Scoring is numpy in Arrow batches, many windows
at once, over every window of every whole text.

Defined cases: a text without words (null, empty, white space) scores 0. Without both classes in the sample all scores
are 0. Texts beyond `features.BLOCK` characters begin a new window at a cut between words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.llm import features
from pitspark.llm.common import fold_of, labelled_sample, table

WINDOW, STRIDE = 48, 24
WORD_BITS, VECTOR_BITS, GRAM_BITS = 20, 13, 20
GRAM = 5
EVIDENCE = 3  # inputs of a word besides its vector
VECTOR, HIDDEN, ATTENTION = 4, 8, 6
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7


@dataclass
class Words:
    """The words of a block: values of the evidence inputs, bucket of the learned vector, and their pieces."""

    evidence: np.ndarray
    bucket: np.ndarray
    first: np.ndarray  # for each piece its first word, and the end at last
    rows: np.ndarray


def _plain(block: features.Block) -> None:
    """Punctuation separates words here."""
    codes = block.codes
    codes[((codes >= 33) & (codes <= 47)) | ((codes >= 58) & (codes <= 64)) | ((codes >= 91) & (codes <= 96)) | ((codes >= 123) & (codes <= 127))] = features.SPACE


def _hashed(block: features.Block):
    """Word hashes, the piece of each word, n-gram buckets, and the n-grams' range of each word."""
    _plain(block)
    hashes, starts, ends = features.words(block)
    piece = np.searchsorted(block.starts, starts, side="right") - 1
    (bucket, _), *_ = features.grams(block, (GRAM,), GRAM_BITS)
    low = starts - 1  # the space before belongs to the first n-gram
    high = np.maximum(low + 1, ends + 2 - GRAM)
    return hashes, piece, bucket, low, high


def evidence(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word bucket and n-gram bucket: the sure part of the log odds that a document
    with it is toxic, squeezed into -1 to 1."""
    counts = [np.zeros((2, 1 << WORD_BITS)), np.zeros((2, 1 << GRAM_BITS))]
    for block in features.blocks(texts, lower=True):
        hashes, piece, bucket, low, high = _hashed(block)
        doc = block.rows[piece]
        reach = high - low
        inside = np.repeat(low - np.concatenate(([0], np.cumsum(reach)[:-1])), reach) + np.arange(reach.sum())
        for bits, at, owner, out in ((WORD_BITS, features.bucket_of(hashes, WORD_BITS), doc, counts[0]), (GRAM_BITS, bucket[inside], np.repeat(doc, reach), counts[1])):
            pairs = np.unique((owner.astype(np.int64) << bits) + at)
            np.add.at(out, (toxic[pairs >> bits], pairs & ((1 << bits) - 1)), 1)
    n1, n0 = toxic.sum() + 1.0, (1 - toxic).sum() + 1.0
    result = []
    for c in counts:
        a, b = c[1] + 0.5 * n1 / (n1 + n0), c[0] + 0.5 * n0 / (n1 + n0)
        odds = np.log(a / (n1 + 1 - a)) - np.log(b / (n0 + 1 - b))
        sure = np.maximum(0, np.abs(odds) - 2.5 * np.sqrt(1 / a + 1 / b))
        result.append((np.sign(odds) * np.tanh(sure / 2)).astype(np.float32))
    return result[0], result[1]


@dataclass
class Model:
    word: np.ndarray
    gram: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0


def inputs(texts: list[str], word: np.ndarray, gram: np.ndarray):
    for block in features.blocks(texts, lower=True):
        hashes, piece, bucket, low, high = _hashed(block)
        total = np.concatenate((np.zeros(1), np.cumsum(gram[bucket], dtype=np.float64)))
        mean = ((total[high] - total[low]) / (high - low)).astype(np.float32)
        # every other range of reduceat is a word's own
        most = np.maximum.reduceat(np.append(gram[bucket], np.float32(0)), np.column_stack([low, high]).ravel())[::2] if len(low) else mean
        own = np.column_stack([word[features.bucket_of(hashes, WORD_BITS)], mean, most])
        first = np.searchsorted(piece, np.arange(len(block.rows) + 1))
        yield Words(own, features.bucket_of(hashes * np.uint64(31), VECTOR_BITS), first, block.rows)


def windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of each window; every word is in one, most are in two."""
    n = np.diff(w.first)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    piece = np.repeat(np.arange(len(n)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = w.first[piece] + step * STRIDE
    return begin, np.minimum(WINDOW, w.first[piece + 1] - begin), w.rows[piece]


def init(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    out = {"vectors": (rng.standard_normal((1 << VECTOR_BITS, VECTOR)) * 0.1).astype(np.float32), "att_w": f(2 * HIDDEN, ATTENTION), "att_v": f(ATTENTION, 1), "out_w": f(2 * HIDDEN, 1), "out_b": np.zeros(1, np.float32)}
    for d in "fb":
        out |= {f"x_{d}": f(EVIDENCE + VECTOR, 3 * HIDDEN), f"h_{d}": f(HIDDEN, 3 * HIDDEN), f"b_{d}": np.zeros(3 * HIDDEN, np.float32)}
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def forward(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. x: time x window x inputs; mask: time x window, true where there is a word."""
    steps, n, _ = x.shape
    h_all = np.empty((steps, n, 2 * HIDDEN), x.dtype)
    tape = {}
    full = bool(mask.all())
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        gx = x @ p[f"x_{d}"] + p[f"b_{d}"]
        wh = p[f"h_{d}"]
        h = np.zeros((n, HIDDEN), x.dtype)
        part = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
        trace = []
        for t in order:
            gh = h @ wh
            gates = _sigmoid(gx[t, :, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            r, u = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(gx[t, :, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            new = c + u * (h - c)
            if not full:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                trace.append((t, h, r, u, c, gh[:, 2 * HIDDEN :]))
            h = new
            h_all[t, :, part] = h
        tape[d] = trace
    a = np.tanh(h_all @ p["att_w"])
    e = (a @ p["att_v"])[..., 0]
    if not full:
        e = np.where(mask, e, -1e9)
    e = np.exp(e - e.max(axis=0))
    share = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", share, h_all)
    logit = (pooled @ p["out_w"])[:, 0] + p["out_b"][0]
    return (logit, (tape, h_all, a, share, pooled)) if keep else logit


def backward(p: dict, x: np.ndarray, mask: np.ndarray, held, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters but `vectors`, and of x."""
    tape, h_all, a, share, pooled = held
    g = {k: np.zeros_like(v) for k, v in p.items() if k != "vectors"}
    g["out_w"] = pooled.T @ d_logit[:, None]
    g["out_b"] = d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["out_w"][:, 0]
    dh_all = share[..., None] * d_pooled[None]
    d_share = np.einsum("nk,tnk->tn", d_pooled, h_all)
    d_e = share * (d_share - (share * d_share).sum(axis=0))
    g["att_v"] = np.einsum("tna,tn->a", a, d_e)[:, None]
    d_a = d_e[..., None] * p["att_v"][:, 0] * (1 - a * a)
    g["att_w"] = np.einsum("tnk,tna->ka", h_all, d_a)
    dh_all += d_a @ p["att_w"].T
    dx = np.zeros_like(x)
    for d in "fb":
        wx, wh = p[f"x_{d}"], p[f"h_{d}"]
        part = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
        dh = np.zeros((x.shape[1], HIDDEN), x.dtype)
        for t, before, r, u, c, ghc in reversed(tape[d]):
            dh = dh + dh_all[t, :, part]
            m = mask[t][:, None]
            dn = np.where(m, dh, 0)
            dc = dn * (1 - u) * (1 - c * c)
            du = dn * (before - c) * u * (1 - u)
            dr = dc * ghc * r * (1 - r)
            dgx = np.concatenate([dr, du, dc], axis=1)
            dgh = np.concatenate([dr, du, dc * r], axis=1)
            g[f"x_{d}"] += x[t].T @ dgx
            g[f"b_{d}"] += dgx.sum(axis=0)
            g[f"h_{d}"] += before.T @ dgh
            dx[t] += dgx @ wx.T
            dh = dn * u + dgh @ wh.T + np.where(m, 0, dh)
    return g, dx


def _gather(w: Words, begin: np.ndarray, size: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = np.arange(int(size.max()))
    at = np.minimum(begin[None, :] + steps[:, None], len(w.bucket) - 1)
    mask = steps[:, None] < size[None, :]
    bucket = w.bucket[at]
    x = np.concatenate([w.evidence[at], vectors[bucket]], axis=2)
    x[~mask] = 0
    return x, mask, bucket


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Model:
    empty = Model(np.zeros(1 << WORD_BITS, np.float32), np.zeros(1 << GRAM_BITS, np.float32))
    if len(set(toxic.tolist())) < 2:
        return empty
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(texts), dtype=bool)
    aside[rng.permutation(len(texts))[: len(texts) // 5]] = True
    learn = np.flatnonzero(~aside)
    word, gram = evidence([texts[i] for i in learn], toxic[learn])
    p = init(seed)
    # windows that teach
    xs, ms, bs, ys = [], [], [], []
    part = np.arange(len(learn)) % 4
    for k in range(4):  # the evidence on a document that teaches comes from the others
        own_part, rest = learn[part == k], learn[part != k]
        for w in inputs([texts[i] for i in own_part], *evidence([texts[i] for i in rest], toxic[rest])):
            begin, size, row = windows(w)
            total = np.concatenate(([0.0], np.cumsum(np.maximum(0, w.evidence).sum(axis=1) ** 2)))
            heat = total[begin + size] - total[begin]
            for r in np.unique(row):
                own = np.flatnonzero(row == r)
                picked = {int(own[np.argmax(heat[own])])}
                label = int(toxic[own_part[r]])
                if not label:
                    picked.add(int(rng.choice(own)))
                for j in sorted(picked):
                    x, m, b = _gather(w, begin[j : j + 1], size[j : j + 1], np.zeros((1 << VECTOR_BITS, VECTOR), np.float32))
                    pad = WINDOW - len(x)
                    xs.append(np.pad(x[:, 0], ((0, pad), (0, 0))))
                    ms.append(np.pad(m[:, 0], (0, pad)))
                    bs.append(np.pad(b[:, 0], (0, pad)))
                    ys.append(label)
    x, m, b, y = np.stack(xs, 1), np.stack(ms, 1), np.stack(bs, 1), np.array(ys, np.float32)
    weight = np.where(y == 1, 0.5 * len(y) / max(1, y.sum()), 0.5 * len(y) / max(1, (1 - y).sum())).astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for begin in range(0, len(y), batch):
            i = order[begin : begin + batch]
            xi = x[:, i].copy()
            xi[..., EVIDENCE:] = p["vectors"][b[:, i]] * m[:, i][..., None]
            logit, held = forward(p, xi, m[:, i], keep=True)
            d = weight[i] * (_sigmoid(logit) - y[i]) / len(i)
            g, dx = backward(p, xi, m[:, i], held, d.astype(np.float32))
            gv = np.zeros_like(p["vectors"])
            np.add.at(gv, b[:, i], dx[..., EVIDENCE:])
            g["vectors"] = gv
            step += 1
            pace = rate * (1 - step / (steps + 1))
            for k in p:  # adaptive moments
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    model = Model(word, gram, p)
    held = np.flatnonzero(aside)
    model.slope, model.shift = _calibrate(logits(model, [texts[i] for i in held]), toxic[held])
    return model


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a weak pull towards slope 1."""
    z = np.clip(np.where(np.isfinite(logit), logit, -20), -20, 20)

    def loss(v):
        t = v[0] * z + v[1]
        return (np.logaddexp(0, t) - y * t).sum() + 0.5 * (v[0] - 1) ** 2 + 0.05 * v[1] ** 2

    v = np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(v[0] * z + v[1])
        g = np.array([((q - y) * z).sum() + (v[0] - 1), (q - y).sum() + 0.1 * v[1]])
        s = q * (1 - q)
        move = np.linalg.solve(np.array([[(s * z * z).sum() + 1, (s * z).sum()], [(s * z).sum(), s.sum() + 0.1]]), g)
        pace = 1.0
        while pace > 1e-6 and loss(v - pace * move) > loss(v):
            pace /= 2
        v = v - pace * move
        if np.abs(pace * move).max() < 1e-8:
            break
    return float(max(v[0], 0.05)), float(v[1])


def logits(model: Model, texts: list[str], at_once: int = 2048) -> np.ndarray:
    """The largest window logit of each text; minus infinity without words."""
    out = np.full(len(texts), -np.inf)
    if not model.weights:
        return out
    for w in inputs(texts, model.word, model.gram):
        begin, size, row = windows(w)
        for group in (np.flatnonzero(size == WINDOW), np.flatnonzero(size < WINDOW)):
            for k in range(0, len(group), at_once):
                own = group[k : k + at_once]
                x, mask, _ = _gather(w, begin[own], size[own], model.weights["vectors"])
                np.maximum.at(out, row[own], forward(model.weights, x, mask))
    return out


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    z = logits(model, texts)
    return np.where(np.isfinite(z), _sigmoid(np.clip(model.slope * np.where(np.isfinite(z), z, 0) + model.shift, -60, 60)), 0.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000) -> Model:
    """Fit on at most `rows` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows)
    return fit(sample["text"].tolist(), sample["target"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            p = probabilities(model, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
