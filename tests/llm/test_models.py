"""Classifiers: held-out accuracy, gradients, odd rows; personal data against plain patterns."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from pitspark.llm import disclosure, features, language, quality, toxicity

SF = "/root/testdata/sf0.1"
here = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def scores(spark, query, sf):
    return query(spark, sf).toPandas()


@here
def test_quality_on_held_out_rows(spark):
    got = scores(spark, quality.query, SF).merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    own = got[got["held_out"]]
    assert (own["predicted"] == own["quality"]).mean() > 0.94 and own.loc[own["quality"] == 1, "predicted"].mean() > 0.98


@here
def test_language_on_held_out_rows(spark):
    got = scores(spark, language.query, SF).merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    own = got[got["held_out"]]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.97


@here
def test_toxicity_on_held_out_rows(spark):
    got = scores(spark, toxicity.query, SF).merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    own = got[got["held_out"]]
    order = own["score"].rank().to_numpy()
    y = own["toxic"].to_numpy()
    auc = (order[y == 1].mean() - (y.sum() + 1) / 2) / (len(y) - y.sum())
    assert auc > 0.9 and own.loc[own["toxic"] == 0, "predicted"].mean() < 0.05


def test_odd_rows(spark, tricky, empty):
    n = tricky.count()
    model = quality.fit(["good text here"] * 20 + ["BAD!! TEXT!!"] * 20, np.array([1] * 20 + [0] * 20))
    out = quality.score(tricky, model).toPandas()
    assert len(out) == n and out["_score"].between(0, 1).all() and list(out.columns)[:-1] == tricky.columns
    assert quality.score(empty, model).count() == 0
    lang = language.predict(tricky, language.train(tricky.withColumn("lang", tricky["lang"]))).collect()
    assert len(lang) == n and {r.lang_pred for r in lang if r.doc_id in (20, 21, 22)} == {"und"} and all(0 <= r.score <= 1 for r in lang)
    assert language.predict(empty, language.train(empty)).count() == 0
    labels = spark.createDataFrame([(5, 1, 1), (3, 0, 0), (3, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    tox = toxicity.score(tricky, toxicity.train(tricky, labels)).collect()
    assert len(tox) == n and all(0 <= r.score <= 1 for r in tox)
    none = labels.limit(0)
    assert {r.score for r in toxicity.score(tricky, toxicity.train(tricky, none)).collect()} == {0.0}
    assert {r["_score"] for r in quality.score(tricky, quality.train(tricky, none)).collect()} == {0.5}
    assert quality.keep_good(tricky, none).columns == tricky.columns


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in toxicity.init().items()}
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5, 3, toxicity.EVIDENCE + toxicity.VECTOR))
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = mask[1:, 2] = False
    x[~mask] = 0
    y = np.array([1.0, 0, 1])
    loss = lambda: float(np.sum(np.logaddexp(0, z := toxicity.forward(p, x, mask)) - y * z))
    z, held = toxicity.forward(p, x, mask, keep=True)
    grads, dx = toxicity.backward(p, x, mask, held, 1 / (1 + np.exp(-z)) - y)
    for flat, grad in [(p[k].ravel(), grads[k].ravel()) for k in grads] + [(x.ravel(), dx.ravel())]:
        for i in rng.integers(0, flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            if grad is not dx.ravel() or mask.ravel()[i // x.shape[2]]:
                assert abs((up - down) / 2e-5 - grad[i]) < 1e-6


def test_windows_cover_every_word():
    for n in (1, toxicity.WINDOW - 1, toxicity.WINDOW, toxicity.WINDOW + 1, 5 * toxicity.WINDOW + 7):
        w = toxicity.Words(np.zeros((n, 3)), np.zeros(n, int), np.array([0, n]), np.array([0]))
        begin, size, _ = toxicity.windows(w)
        assert set(range(n)) == {i for b, s in zip(begin, size, strict=True) for i in range(b, b + s)} and (np.diff(begin) == toxicity.STRIDE).all()


def test_features_do_not_depend_on_the_company():
    texts = ["alpha beta", "", "gamma " * 9, "x"]
    model = quality.Model(np.random.default_rng(0).standard_normal(1 << quality.BITS).astype(np.float32), 0.1)
    together = quality.probabilities(model, texts)
    assert np.allclose(together, [quality.probabilities(model, [t])[0] for t in texts])
    long = "word " * (features.BLOCK // 4)
    assert sum(len(features.words(b)[0]) for b in features.blocks([long])) == len(long.split())


E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # noqa: E741
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v for i, c in enumerate(reversed(d))) % 10 == 0


def plain(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in E.finditer(t)],
        "ip": [m.span() for m in I.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in C.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in P.finditer(t) if 9 <= len(digits(m)) <= 15],
    }


def test_entities_by_plain_patterns():
    rng = random.Random(1)
    for alphabet in ("ab.@1250 -+()%\n٣é", "0123456789 -.", "a.@-"):
        for _ in range(6000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert plain(t) == disclosure.entities(t), t
    assert disclosure.entities("0" * 9000 + "1.2.3.4 " + "a" * 200_000)["ip"] == [(0, 9007)]


def test_disclosing_terms(spark, tmp_path, tricky, empty):
    rows = [(i, f"the passport holder writes to user{i}@mail.example.org today" if i % 4 == 0 else "the holder went home today again") for i in range(400)]
    file = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(file)
    docs = spark.read.parquet(file)
    terms = disclosure.learn(docs, disclosure.Limits(bits=0.2, generalise=0.9))
    assert {"passport", "writes", "to"} <= set(terms) and "holder" not in terms and "today" not in terms
    got = {r.doc_id: r for r in disclosure.find(docs, terms, with_text=True).collect()}
    assert "term:4:12" in got[0].spans and got[0].text == "the  holder   <email> today" and got[1].spans == ""
    out = disclosure.find(tricky, disclosure.learn(tricky)).collect()
    assert len(out) == tricky.count() and {r.doc_id: r.base for r in out}[50].count(":") == 8
    assert disclosure.find(empty, disclosure.learn(empty)).count() == 0


def test_rare_disclosing_terms_in_a_large_corpus(spark, tmp_path):
    """A word beside 3 of 2,400 e-mails is a term, and so are words with digits; many terms are joined, not broadcast."""
    rows = [(i, f"one may write to user@mail.example.org or call on a day like this and talk of {i % 7} things at length in the town {'and so on ' * 60}") for i in range(2400)]
    rows += [(5000 + i, "Zebulon case_77 ΟΔΟΣ.Α İzmir a@b.example.org now") for i in range(3)] + [(6000, None), (6001, "zebulon İZMIR alone"), (6001, "zebulon İZMIR alone")]
    file = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(file)
    docs = spark.read.parquet(file)
    table = disclosure.term_table(docs)
    terms = disclosure.learn(docs)
    assert terms["zebulon"].share == 3 / 5 and terms["case_77"].share == 1 and terms["i̇zmir"].share == 3 / 5 and "and" not in terms
    key = lambda r: tuple(map(str, r))
    few = disclosure.find(docs, table, with_text=True).collect()
    assert sorted(few, key=key) == sorted(disclosure.find(docs, terms, with_text=True).collect(), key=key)
    assert sorted(few, key=key) == sorted(disclosure.find(docs, table, with_text=True, broadcast_terms=0).collect(), key=key)
    assert {r.spans for r in few if r.doc_id == 6001} == {"term:0:7,term:8:13"}
