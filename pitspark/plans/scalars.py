"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions import text as X
from pitspark.functions.fixed import FEATURE_TOKENS, TIER_SUBSTRING_DEFAULT
from pitspark.functions.mathfn import clip as clip_col
from pitspark.functions.mathfn import rnd, safe_ln, softmax
from pitspark.operators.versions import keep_first
from pitspark.plans.registry import query, view
from pitspark.plans.sources import TEST_THEMES
from pitspark.sources.views import Tables

C = F.col


@query("contains_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def contains_filter(t: Tables):
    """Case-insensitive literal substring filter."""
    return t.read("part").filter(X.contains_ci(C("p_name"), "RING")).select("p_partkey", "p_name")


@query(
    "bias_tier",
    """SELECT article_id, source, CASE source WHEN 'src1' THEN 'tier_a' WHEN 'src2' THEN 'tier_b' ELSE 'tier_default' END AS exact_tier,
              CASE WHEN contains(source, 'c1') THEN 'first' WHEN contains(source, '5') THEN 'second' WHEN contains(source, '1') THEN 'third'
              ELSE 'aggregator_neutral' END AS substring_tier FROM articles""",
    "articles",
)
def bias_tier(t: Tables):
    """Source tier by exact key and by first matching substring."""
    return t.article_times.select(
        "article_id",
        "source",
        X.map_exact(C("source"), {"src1": "tier_a", "src2": "tier_b"}, "tier_default").alias("exact_tier"),
        X.map_first_substring(
            C("source"), {"c1": "first", "5": "second", "1": "third"}, TIER_SUBSTRING_DEFAULT
        ).alias("substring_tier"),
    )


@query(
    "dedupe_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
       ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_first(t: Tables):
    """Deterministic keep-first deduplication."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    src = t.read("lineitem").select("l_orderkey", "l_linenumber", *order)
    kept = keep_first(src, ["l_orderkey", "l_linenumber"], order)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "clip",
    """SELECT o_orderkey, CASE WHEN x IS NOT NULL THEN least(greatest(x, 0), 200) END::DOUBLE AS clipped
       FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 1000.0 - 50, 6) END AS x FROM orders)""",
)
def clip(t: Tables):
    """Bound values, keeping missing ones missing."""
    x = F.when(C("o_orderstatus") != "P", rnd(C("o_totalprice") / 1000.0 - 50))
    return t.read("orders").select("o_orderkey", clip_col(x, 0, 200).alias("clipped"))


@query(
    "safe_log",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS log_balance FROM customer",
)
def safe_log(t: Tables):
    """Logarithm of positive values, NULL otherwise."""
    return t.read("customer").select("c_custkey", rnd(safe_ln(C("c_acctbal"))).alias("log_balance"))


@query(
    "article_text",
    r"""WITH p AS (SELECT page_id, url AS title, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS body FROM pages)
       SELECT page_id, CASE WHEN body = '' THEN title ELSE title || chr(10) || chr(10) || substr(body, 1, 1500) END AS text FROM p""",
)
def article_text(t: Tables):
    """Title, blank line and body start."""
    body = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return t.read("pages").select("page_id", X.article_text(C("url"), body, body_chars=1500).alias("text"))


@query(
    "theme_flags",
    f"""SELECT article_id, {', '.join(f"regexp_matches(body, '{p}') AS {n}" for n, p in TEST_THEMES.items())} FROM articles""",
    "articles",
)
def theme_flags(t: Tables):
    """One boolean per theme family."""
    flags = X.pattern_flags(C("body"), TEST_THEMES)
    return t.articles.select("article_id", *[c.alias(n) for n, c in flags.items()])


_SUFFIXES = ("regime_low", "fomc_days", "news_count", "real_rate", "close_ratio", "atr_14", "vixcls", "open", "size")
view(
    "feature_names",
    "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || [" + ", ".join(f"'{s}'" for s in _SUFFIXES)
    + "][(p_partkey % 9)::INT + 1] AS name, p_retailprice - 900 AS importance FROM part",
)
view(
    "feature_cats",
    "SELECT *, CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(name), '{tok}')" for tok in toks) + f" THEN '{cat}'"
        for cat, toks in FEATURE_TOKENS.items()
    )
    + " ELSE 'other' END AS category FROM feature_names",
    "feature_names",
)


def feature_names(t: Tables):
    """One named feature with a signed score per part."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (C("p_partkey") % 9 + 1).cast("int"))
    name = F.concat(F.replace(C("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), suffix)
    return t.read("part").select("p_partkey", name.alias("name"), (C("p_retailprice") - 900).alias("importance"))


@query("feature_category", "SELECT p_partkey, name, category FROM feature_cats", "feature_cats")
def feature_category(t: Tables):
    """Category of a feature name by ordered token lists."""
    return feature_names(t).select("p_partkey", "name", X.feature_category(C("name")).alias("category"))


@query(
    "symbols_explode",
    """WITH s AS (SELECT p_partkey, p_brand || '|' || p_type || '|' || replace(p_name, ' ', '|') AS symbols FROM part)
       SELECT p_partkey, unnest(string_split(symbols, '|')) AS symbol FROM s""",
)
def symbols_explode(t: Tables):
    """Pipe-separated symbols to rows."""
    s = t.read("part").select(
        "p_partkey",
        F.array_join(F.concat(F.array("p_brand", "p_type"), F.split("p_name", " ")), "|").alias("symbols"),
    )
    return s.select("p_partkey", F.explode(F.split("symbols", r"\|")).alias("symbol"))


@query(
    "json_props",
    """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.missing') AS missing,
              '{"k":' || (json_extract(props, '$.k')::BIGINT + 1)::VARCHAR || ',"kind":"' || event_type || '"}' AS encoded FROM events""",
)
def json_props(t: Tables):
    """Decode properties and encode a derived object."""
    k = F.from_json("props", "k long")["k"]
    return t.read("events").select(
        "event_id",
        k.alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
        F.to_json(F.struct((k + 1).alias("k"), C("event_type").alias("kind"))).alias("encoded"),
    )


@query("article_key", "SELECT page_id, sha256(url || '|' || page_id::VARCHAR) AS article_key FROM pages")
def article_key(t: Tables):
    """Stable id from the identifying parts."""
    return t.read("pages").select("page_id", X.row_key(C("url"), C("page_id").cast("string")).alias("article_key"))


view(
    "probs15",
    """SELECT *, exp(logit / 1.5 - max(logit / 1.5) OVER w) / sum(exp(logit / 1.5)) OVER w * exp(max(logit / 1.5) OVER w) AS p
       FROM scorelong WINDOW w AS (PARTITION BY row_id)""",
    "scorelong",
)


@query("softmax_t", "SELECT row_id, class, round(p, 6) AS p FROM probs15", "probs15")
def softmax_t(t: Tables):
    """Tempered softmax of the class scores."""
    p = t.scores.select("row_id", F.explode(F.arrays_zip("classes", softmax(C("logits"), 1.5).alias("p"))).alias("z"))
    return p.select("row_id", C("z.classes").alias("class"), rnd(C("z.p")).alias("p"))
