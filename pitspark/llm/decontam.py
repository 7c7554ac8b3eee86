"""Benchmark decontamination by a distributed positional inverted index.

A window is a run of consecutive words of a benchmark item. The index has the postings (document, position) of the terms
that are the rarest of some window in the training texts. A window's lists, shifted by the terms' places in it, are
intersected from the rarest on; what is left is a place where all rare terms agree, and is compared word by word. A
proximity match asks only that the rare terms stand within a slack of their places.

Everything is DataFrame expressions. The word tables of the benchmark are broadcast only if they are counted to be below
a limit; else they are joined by shuffle.

Defined cases: a null or empty text has no word, and is not contaminated. A benchmark item without words has no window.
Repeated items count once for each item_id; repeated documents get one result each. Empty tables give no hit or no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import fresh, keyed_texts, lower_ascii, stored, table, texts_of, with_row_id

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    """Words as they stand in the text; `_lowered` each of them."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _lowered(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(lower_ascii(word))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, size: int = 13) -> DataFrame:
    """Distinct windows: window (number), words, items (the item ids that have it, as strings)."""
    words = F.transform(_words(F.coalesce(F.col("text"), F.lit(""))), _lowered)
    long = items.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    each = long.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("words"))
    distinct = each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return stored(distinct.withColumn("window", F.monotonically_increasing_id()))


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("rid", F.posexplode(_words(F.col("text"))).alias("pos", "w")).select("rid", "pos", _lowered(F.col("w")).alias("term"))


def rare_terms(docs: DataFrame, win: DataFrame, lists: int) -> DataFrame:
    """For each window its `lists` rarest distinct terms: window, rank, term, at (the place of the term there)."""
    places = win.select("window", F.posexplode("words").alias("at", "term")).groupBy("window", "term").agg(F.min("at").alias("at"))
    vocabulary = places.select("term").distinct()
    counts = _tokens(docs).select("term").join(_small(vocabulary, vocabulary.count()), "term").groupBy("term").agg(F.count("*").alias("n"))
    rated = places.join(counts, "term", "left").select("window", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term").alias("e"))
    rated = rated.groupBy("window").agg(F.slice(F.array_sort(F.collect_list("e")), 1, lists).alias("e"))
    return stored(rated.select("window", F.posexplode("e").alias("rank", "e")).select("window", "rank", "e.term", "e.at", "e.n"))


def index(docs: DataFrame, rare: DataFrame) -> DataFrame:
    """The stored postings (term, rid, pos) of the rare terms."""
    terms = rare.filter(F.col("n") > 0).select("term").distinct()
    return stored(_tokens(docs).join(_small(terms, terms.count()), "term"))


def candidates(postings: DataFrame, rare: DataFrame, lists: int, slack: int = 0) -> DataFrame:
    """(rid, start, window) at which the postings of all rare terms of the window agree, up to `slack` places."""
    n = rare.count()
    of = lambda rank: rare.filter(F.col("rank") == rank).select("window", F.col("term").alias("term"), "at")
    found = postings.join(_small(of(0), n), "term").select("rid", "window", (F.col("pos") - F.col("at")).alias("start"))
    for rank in range(1, lists):
        wanted = found.join(_small(of(rank).withColumnRenamed("term", "next"), n), "window", "left")
        spread = F.explode(F.sequence(F.col("start") + F.col("at") - slack, F.col("start") + F.col("at") + slack)) if slack else F.col("start") + F.col("at")
        ask = wanted.filter(F.col("next").isNotNull()).select("rid", "window", "start", F.col("next").alias("term"), spread.alias("pos"))
        met = ask.join(postings, ["rid", "term", "pos"], "left_semi").select("rid", "window", "start")
        found = (met.distinct() if slack else met).unionByName(wanted.filter(F.col("next").isNull()).select("rid", "window", "start"))
    return found


def match(docs: DataFrame, items: DataFrame, size: int = 13, lists: int = 3) -> DataFrame:
    """One row for each document: rid, doc_id, n_words, n_hit (words inside any occurrence of a window), items (ids of the
    items with occurring windows), runs (first and next word of each occurrence, from 0, by start)."""
    return match_texts(keyed_texts(docs), items, size, lists)


def match_texts(keyed: DataFrame, items: DataFrame, size: int = 13, lists: int = 3) -> DataFrame:
    """`match` for rows with numbers: rid, doc_id and text."""
    win = windows(items, size)
    rare = rare_terms(keyed, win, lists)
    found = candidates(index(keyed, rare), rare, lists)
    # places before a document's first word are no occurrences; those beyond its last one fail the comparison
    found = found.filter(F.col("start") >= 0).join(_small(win, win.count()), "window")
    found = found.groupBy("rid").agg(F.collect_list(F.struct("start", "words", "items")).alias("found"))
    words = F.col("w")
    same = lambda c: F.transform(F.slice(words, c["start"] + 1, F.size(c["words"])), _lowered) == c["words"]
    real = keyed.select("rid", "doc_id", _words(F.col("text")).alias("w")).join(found, "rid", "left")
    real = real.select("rid", "doc_id", F.size("w").alias("n_words"), F.when(F.col("found").isNull(), None).otherwise(F.filter("found", same)).alias("real"))
    runs = F.array_sort(F.transform("real", lambda c: F.struct(c["start"].alias("a"), (c["start"] + F.size(c["words"])).alias("b"))))
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    out = real.withColumn("runs", F.coalesce(runs, none))
    ids = F.coalesce(F.sort_array(F.array_distinct(F.flatten(F.transform("real", lambda c: c["items"])))), F.expr("cast(array() as array<string>)"))
    # runs come by their start: count what reaches beyond the furthest end so far
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end"))
    hit = F.aggregate("runs", start, step, lambda s: s["n"])
    return out.select("rid", "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), ids.alias("items"), "runs")


def proximity(docs: DataFrame, items: DataFrame, size: int = 13, lists: int = 3, slack: int = 3) -> DataFrame:
    """(doc_id, start, window, items) at which a window's rarest terms stand within `slack` places of where they belong."""
    keyed = keyed_texts(docs)
    win = windows(items, size)
    rare = rare_terms(keyed, win, lists)
    found = candidates(index(keyed, rare), rare, lists, slack)
    return found.join(_small(win, win.count()), "window").join(keyed.select("rid", "doc_id"), "rid").select("doc_id", "start", F.col("words").alias("window"), "items")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns."""
    row = fresh(docs.columns, "row")
    rows = with_row_id(docs, row)
    bad = match_texts(texts_of(rows, row), items).filter(contaminated()).select(F.col("rid").alias(row))
    return rows.join(bad, row, "left_anti").drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    out = match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, n WHERE len(w) >= n)
), h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
