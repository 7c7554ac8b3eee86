"""News vectors and source weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions.mathfn import rnd
from pitspark.operators import vectors as V
from pitspark.operators.intervals import trailing_count
from pitspark.plans.registry import query, view
from pitspark.sources.views import DAY, HOUR, Tables

C = F.col


@query("anchor_vectors", "SELECT label, dim, round(a, 6) + 0.0 AS value FROM anchors", "anchors")
def anchor_vectors(t: Tables):
    """Normalised mean vector per class."""
    a = t.anchors.select("label", F.posexplode("anchor").alias("dim", "v"))
    return a.select("label", C("dim").cast("long").alias("dim"), rnd(C("v")).alias("value"))


view(
    "cosines",
    """SELECT v.article_id, a.label AS class, sum(v.v * a.a) / (sqrt(sum(v.v * v.v)) * sqrt(sum(a.a * a.a))) AS cosine
       FROM veclong v JOIN anchors a USING (dim) GROUP BY 1, 2""",
    "veclong anchors",
)


def cosines(t: Tables):
    return V.anchor_cosines(t.vectors, t.anchors, id="article_id", vec="vec")


@query("anchor_cosine", "SELECT article_id, class, round(cosine, 6) + 0.0 AS cosine FROM cosines", "cosines")
def anchor_cosine(t: Tables):
    """Cosine of every article with every anchor."""
    return cosines(t).select("article_id", "class", rnd(C("cosine")).alias("cosine"))


@query(
    "bar_anchor_stats",
    """WITH p AS (SELECT b.bar_close, c.class, c.cosine, row_number() OVER (PARTITION BY b.bar_close, c.class ORDER BY cosine DESC) AS rn
                  FROM (SELECT DISTINCT bar_close FROM bars) b JOIN articles a ON a.t_visible >= b.bar_close - INTERVAL 4 HOUR AND a.t_visible < b.bar_close
                  JOIN cosines c USING (article_id)),
       s AS (SELECT bar_close, class, count(*) AS n, avg(cosine) AS mean_cosine, max(cosine) AS max_cosine, avg(cosine) FILTER (WHERE rn <= 5) AS top_cosine FROM p GROUP BY 1, 2)
       SELECT b.symbol, b.bar_close, s.class, coalesce(s.n, 0) AS n_visible, round(mean_cosine, 6) + 0.0 AS mean_cosine, round(max_cosine, 6) + 0.0 AS max_cosine,
              round(top_cosine, 6) + 0.0 AS top_cosine, s.n IS NOT NULL AS has_news FROM bars b LEFT JOIN s USING (bar_close)""",
    "bars articles cosines",
)
def bar_anchor_stats(t: Tables):
    """Mean, max and top-five cosine per anchor over the articles a bar sees."""
    seen = cosines(t).join(t.article_times.select("article_id", "t_visible"), "article_id")
    out = V.bar_anchor_stats(
        t.bars.select("symbol", "bar_close"), seen, at="bar_close", time="t_visible", seconds=HOUR, lookback=4
    )
    num = ("mean_cosine", "max_cosine", "top_cosine")
    return out.select("symbol", "bar_close", "class", "n_visible", *[rnd(C(c)).alias(c) for c in num], "has_news")


@query(
    "source_weight",
    """SELECT article_id, source, round(1.0 / count(*) OVER (PARTITION BY source ORDER BY created_at
              RANGE BETWEEN INTERVAL '29 days 23:59:59.999999' PRECEDING AND CURRENT ROW), 6) AS weight FROM articles""",
    "articles",
)
def source_weight(t: Tables):
    """Inverse of the source's article count over the trailing 30 days."""
    a = t.article_times.select("article_id", "source", "created_at")
    out = trailing_count(a, by=["source"], time="created_at", tie=["article_id"], seconds=30 * DAY, out="n")
    return out.select("article_id", "source", rnd(F.lit(1.0) / C("n")).alias("weight"))


@query(
    "anchor_cohesion",
    """WITH u AS (SELECT v.article_id, v.label, v.dim, v.v / n.norm AS u FROM veclong v JOIN (SELECT article_id, sqrt(sum(v * v)) AS norm FROM veclong GROUP BY 1) n USING (article_id)),
       d AS (SELECT label, dim, sum(u) AS s FROM u GROUP BY 1, 2), q AS (SELECT label, sum(s * s) AS sq FROM d GROUP BY 1),
       c AS (SELECT u.label, u.article_id, sum(u.u * a.a) AS c FROM u JOIN anchors a ON a.label = u.label AND a.dim = u.dim GROUP BY 1, 2),
       m AS (SELECT label, count(*) AS n, min(c) AS c FROM c GROUP BY 1)
       SELECT label, n, round((sq - n) / (n * (n - 1)), 6) AS mean_pairwise, round(c, 6) AS min_to_anchor, round(CASE WHEN c >= 0 THEN 2 * c * c - 1 ELSE -1.0 END, 6) AS pair_floor
       FROM q JOIN m USING (label)""",
    "veclong anchors",
)
def anchor_cohesion(t: Tables):
    """Pairwise tightness of each class without comparing pairs."""
    out = V.cohesion(t.vectors, t.anchors, by="label", vec="vec")
    num = ("mean_pairwise", "min_to_anchor", "pair_floor")
    return out.select("label", "n", *[rnd(C(c)).alias(c) for c in num])


@query(
    "anchor_min_pairwise",
    """WITH v AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS e FROM embeddings),
       u AS (SELECT * FROM v WHERE list_inner_product(e, e) > 0),
       m AS (SELECT a.label, min(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)))) AS c
             FROM u a JOIN u b ON a.label IS NOT DISTINCT FROM b.label AND a.vec_id < b.vec_id GROUP BY 1)
       SELECT u.label, count(*) AS n, round(any_value(m.c), 6) AS min_pairwise FROM u LEFT JOIN m ON m.label IS NOT DISTINCT FROM u.label GROUP BY u.label""",
)
def anchor_min_pairwise(t: Tables):
    """Exact smallest cosine inside each class, by pivot bounds over blocks."""
    out = V.min_pairwise(t.vectors, t.anchors, by="label", id="article_id", vec="vec")
    return out.select("label", "n", rnd(C("min_pairwise")).alias("min_pairwise"))
