"""Personal data by patterns, and information-theoretic sanitisation of the words that give it away.

Protected entities are found by patterns (e-mail, IP address, card, phone). Over the whole corpus it is counted how often
a word stands within `reach` words of an entity of a kind, and how often it stands anywhere. The pointwise information
log2(P(kind near | word) / P(kind near)) says how strongly the word reveals the entity. A word that reaches `bits` and
whose P(kind near | word) is at least `generalise` is a disclosing term and is generalised to its kind; from `remove` on
it is removed. Every word counts that stands near at least `support` of a kind's entities, a number that does not depend on
the size of the corpus, so a rare word is found in a large corpus as in a small one. Counts and terms are tables: the
number of terms has no bound. Terms are given to the workers whole if a count shows that they are few; else each document
gets its own terms by a join on its words.

Defined cases: a null text is empty and has no span. Repeated rows count as often as they occur and get equal results. A
corpus without entities has no disclosing term.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.llm.common import keyed_texts, stored, table

KINDS = ("email", "ip", "card", "phone")
BROADCAST_TERMS = 100_000
FILTER_BITS = 24  # of the filter that thins words before they are shuffled; 2 MB whatever the input
SALTS = 32  # parts of a term that very many documents hold
HELD_WORDS = 200_000  # distinct words that a task counts before it hands them on
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can begin only where a run of digits begins: one that failed there fails inside the run, too
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        low = domain.end() if domain else at + 1
        if domain:
            found.append((start, low))
        at = text.find("@", low)
    return found


def _luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (double + sum(map(int, digits[-1::-2]))) % 10 == 0


def _card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and _luhn(digits)


def entities(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping spans of each kind, in code points."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _card(m[0].replace(" ", "").replace("-", ""))]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _context(text: str, span: Span, reach: int) -> list[tuple[str, int, int]]:
    """The `reach` words before and after a span, lower-cased, with their places."""
    before: list[re.Match] = []
    size = 16 * reach
    while True:  # look back over a growing stretch, to a word border
        low = max(0, span[0] - size)
        before = [m for m in _WORD.finditer(text, low, span[0]) if m.start() > low or low == 0]
        if len(before) >= reach or low == 0:
            break
        size *= 4
    after = []
    for m in _WORD.finditer(text, span[1]):
        if len(after) == reach:
            break
        after.append(m)
    return [(m[0].lower(), *m.span()) for m in [*before[-reach:], *after]]


@dataclass(frozen=True)
class Limits:
    reach: int = 5
    support: int = 2
    bits: float = 3.0
    generalise: float = 0.25
    remove: float = 0.75


@dataclass(frozen=True)
class Term:
    kind: str
    share: float
    information: float


def near_counts(docs: DataFrame, limits: Limits) -> DataFrame:
    """(kind, word, n): entities of a kind with the word near them; word null: all entities of the kind."""
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            count: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found = entities(text)
                for kind, own in found.items():
                    for span in own:
                        count[kind, None] += 1
                        count.update((kind, w) for w in {w for w, _, _ in _context(text, span, limits.reach)})
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array(list(count.values()), pa.int64())], names=["kind", "word", "n"])

    return docs.select(F.coalesce(F.col("text"), F.lit(""))).mapInArrow(run, schema).groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _words(text: str) -> list[str]:
    """The words, each lower-cased by itself as `_context` and `spans` do: a whole text can lower differently."""
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def _filter(words: DataFrame) -> bytes:
    """A bit for the checksum of each word: at most 2**FILTER_BITS / 64 rows come to the driver."""
    bit = F.crc32(F.col("word").cast("binary")).bitwiseAND((1 << FILTER_BITS) - 1)
    got = words.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("v")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype="<i8")
    out[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64)
    return out.tobytes()


def _passes(word: str, bits: bytes) -> int:
    bit = zlib.crc32(word.encode()) & ((1 << FILTER_BITS) - 1)
    return bits[bit >> 3] >> (bit & 7) & 1


def word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n): how often each of `words` (and few others) occurs in the corpus; word null: how many words the corpus has."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    bits = _filter(words)

    def run(batches):
        count: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            here: Counter = Counter()
            for text in batch.column(0).to_pylist():
                here.update(_words(text))
            count[None] += here.total()
            for w, n in here.items():
                if _passes(w, bits):
                    count[w] += n
            if len(count) > HELD_WORDS:
                yield flush()
                count.clear()
        yield flush()

    return docs.select(F.coalesce(F.col("text"), F.lit(""))).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def term_table(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(word, kind, share, information): the disclosing terms of a corpus, stored."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("information", T.DoubleType())])
    near = stored(near_counts(docs, limits))
    totals = {r["kind"]: r["n"] for r in near.filter(F.col("word").isNull()).collect()}  # a row a kind
    if not totals:
        return docs.sparkSession.createDataFrame([], schema)
    passed = near.filter(F.col("word").isNotNull() & (F.col("n") >= limits.support))
    counts = stored(word_counts(docs, passed))
    everything = max(1, counts.filter(F.col("word").isNull()).first()["n"])
    base = {k: min(1.0, 2 * limits.reach * n / everything) for k, n in totals.items()}

    def run(batches):
        for batch in batches:
            out = []
            for word, kind, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                share = min(1.0, n / total)
                information = math.log2(share / base[kind])
                if information >= limits.bits and share >= limits.generalise:
                    out.append((word, kind, share, information))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=[f.name for f in schema])

    # a word that an entity cuts in two has parts that are no words of the corpus; these have no total
    rated = passed.select("word", "kind", "n").join(counts.select("word", F.col("n").alias("total")), "word").mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("share")).alias("s"), "kind", "information")).alias("best")  # of equal shares the first kind
    return stored(rated.groupBy("word").agg(best).select("word", "best.kind", (-F.col("best.s")).alias("share"), "best.information"))


def _as_dict(terms: DataFrame) -> dict[str, Term]:
    return {r["word"]: Term(r["kind"], r["share"], r["information"]) for r in terms.collect()}


def learn(docs: DataFrame, limits: Limits = Limits()) -> dict[str, Term]:
    """The disclosing terms of a corpus on the driver. A large corpus may have very many: see `term_table`."""
    return _as_dict(term_table(docs, limits))


def _own_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text, own): the documents with the terms among their words."""
    texts = stored(keyed_texts(docs))
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("word", T.StringType())])
    bits = _filter(terms)

    def run(batches):
        for batch in batches:
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = [w for w in set(_words(text)) if _passes(w, bits)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * len(found), pa.int64()), pa.array(found, pa.string())], names=["rid", "word"])

    salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = texts.select("rid", "text").mapInArrow(run, schema).withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    own = held.join(salted, ["word", "salt"]).groupBy("rid").agg(F.collect_list(F.struct("word", "kind", "share", "information")).alias("own"))
    return texts.join(own, "rid", "left").select("doc_id", "text", "own")


def spans(text: str, terms: dict[str, Term], limits: Limits = Limits()) -> tuple[dict[str, list[Span]], list[Span]]:
    """The entities of a text, and the disclosing terms outside them."""
    found = entities(text)
    if not terms:
        return found, []
    taken = sorted(s for v in found.values() for s in v)
    added, k, end = [], 0, -1
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            end = max(end, taken[k][1])
            k += 1
        if end <= m.start() and m[0].lower() in terms:
            added.append(m.span())
    return found, added


def sanitise(text: str, terms: dict[str, Term], limits: Limits = Limits()) -> str:
    """The text with each entity replaced by its kind, and each disclosing term generalised to its kind or removed."""
    found, added = spans(text, terms, limits)
    cuts = [(a, b, f"<{k}>") for k, v in found.items() for a, b in v]
    for a, b in added:
        term = terms[text[a:b].lower()]
        cuts.append((a, b, "" if term.share >= limits.remove else f"<near {term.kind}>"))
    out, at = [], 0
    for a, b, new in sorted(cuts, key=lambda c: (c[0], -c[1])):
        if a < at:  # inside an entity that is replaced already
            at = max(at, b)
            continue
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, terms: dict[str, Term] | DataFrame, limits: Limits = Limits(), with_text: bool = False, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """For each row: doc_id, n_<kind>, base (kind:start:end of the entities), spans (with the terms), and, if asked for,
    the sanitised text. `terms` may be the table of `term_table`; of more than `broadcast_terms`, each document gets its own."""
    fields = [docs.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]
    schema = T.StructType(fields + ([T.StructField("text", T.StringType())] if with_text else []))

    docs, known = docs.select("doc_id", "text"), terms
    if isinstance(terms, DataFrame):
        if terms.limit(broadcast_terms + 1).count() <= broadcast_terms:
            known = _as_dict(terms)
        else:
            docs, known = _own_terms(docs, terms), None

    def run(batches):
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base, every, clean = [], [], []
            own_terms = batch.column("own").to_pylist() if known is None else [None] * batch.num_rows
            for text, mine in zip(batch.column("text").to_pylist(), own_terms, strict=True):
                text = text or ""
                terms = {t["word"]: Term(t["kind"], t["share"], t["information"]) for t in mine or ()} if known is None else known
                found, added = spans(text, terms, limits)
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(len(found[k]))
                own = [f"{k}:{a}:{b}" for k in KINDS for a, b in found[k]]
                base.append(",".join(own))
                every.append(",".join(own + [f"term:{a}:{b}" for a, b in added]))
                if with_text:
                    clean.append(sanitise(text, terms, limits))
            cols = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(clean, pa.string())] if with_text else []), names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = find(docs, term_table(docs))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
