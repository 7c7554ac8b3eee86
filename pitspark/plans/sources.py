"""Scans, conformers, unions, snapshots and text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitspark.functions import text as X
from pitspark.functions.fixed import TIER_EXACT_DEFAULT
from pitspark.functions.mathfn import rnd
from pitspark.functions.visibility import next_open
from pitspark.operators.versions import keep_first
from pitspark.plans.registry import query
from pitspark.sources import cursor, ingest, snapshot
from pitspark.sources.views import Tables

C = F.col

# Word families standing in for theme codes in the test documents.
TEST_THEMES = {"alpha": "thand|erhe", "beta": "tionen|reau", "gamma": "cióngañ|osla", "delta": "heit|lich"}


def _sql_alt(families: dict[str, str]) -> str:
    return "|".join(f"(?:{p})" for p in families.values())


@query(
    "union_sources",
    """SELECT symbol AS series, bar_open AS date, close AS value, NULL::TIMESTAMP AS realtime_start, volume FROM daily
       UNION ALL SELECT series_id, date, value, realtime_start, NULL FROM vintages""",
    "daily vintages",
)
def union_sources(t: Tables):
    """Two sources with different columns as one long table."""
    a = t.daily.select(C("symbol").alias("series"), C("bar_open").alias("date"), C("close").alias("value"), "volume")
    b = t.vintages.select(C("series_id").alias("series"), "date", "value", "realtime_start")
    return ingest.union_sources([a, b]).select("series", "date", "value", "realtime_start", "volume")


@query(
    "source_preference",
    """WITH a AS (SELECT symbol, bar_open, close, CASE WHEN volume > 2 THEN high END AS high FROM daily WHERE volume > 1),
            b AS (SELECT symbol, bar_open, open AS close, low AS high FROM daily)
       SELECT symbol, bar_open, coalesce(a.close, b.close) AS close, coalesce(a.high, b.high) AS high,
              CASE WHEN a.close IS NOT NULL THEN 'primary' ELSE 'backup' END AS source
       FROM a FULL JOIN b USING (symbol, bar_open)""",
    "daily",
)
def source_preference(t: Tables):
    """Column-wise fallback from a preferred to a backup source."""
    d = t.daily
    primary = d.filter(C("volume") > 1).select(
        "symbol", "bar_open", "close", F.when(C("volume") > 2, C("high")).alias("high")
    )
    backup = d.select("symbol", "bar_open", C("open").alias("close"), C("low").alias("high"))
    return ingest.prefer_sources({"primary": primary, "backup": backup}, ["symbol", "bar_open"], ["close", "high"])


_FP = """SELECT count(*) AS n_rows, sum(h)::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM
    (SELECT ('0x' || substr(md5(concat_ws('|', coalesce(event_id::VARCHAR, '\\N'), coalesce(epoch_us(ts)::VARCHAR, '\\N'), coalesce(user_id::VARCHAR, '\\N'),
     coalesce(event_type, '\\N'), coalesce(round(value * 1000000)::DECIMAL(38,0)::VARCHAR, '\\N'), coalesce(props, '\\N'))), 1, 12))::BIGINT AS h FROM events)"""


@query("table_fingerprint", _FP)
def table_fingerprint(t: Tables):
    """Order-independent content hash of the event table."""
    return snapshot.fingerprint(t.read("events"), portable=True).drop("digest")


@query(
    "snapshot_meta",
    "SELECT count(*) AS row_count, 6::BIGINT AS column_count, min(ts) AS first_ts, max(ts) AS last_ts, 'events' AS sources FROM events",
)
def snapshot_meta(t: Tables):
    """Row and column count and time range."""
    return snapshot.snapshot_meta(t.read("events"), "ts", ["events"])


@query(
    "theme_filter",
    f"""SELECT article_id, created_at, source FROM articles WHERE created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
        AND (lang IS NULL OR lang = '' OR lang = 'en') AND regexp_matches(body, '{_sql_alt(TEST_THEMES)}')""",
    "articles",
)
def theme_filter(t: Tables):
    """Articles of a time range and language that mention any theme."""
    lo, hi = (F.lit(s).cast("timestamp_ntz") for s in ("2024-01-05", "2024-01-25"))
    a = t.articles.filter(C("lang").isNull() | C("lang").isin("", "en")).filter(C("created_at").between(lo, hi))
    return a.filter(X.any_pattern(C("body"), TEST_THEMES)).select("article_id", "created_at", "source")


@query(
    "keyword_filter",
    r"""SELECT article_id::VARCHAR || '_' || source AS article_id, 'forum_' || lower(source) AS source, created_at FROM articles
        WHERE source IN ('src1', 'src3', 'src5', 'src7', 'src11') AND epoch(created_at) BETWEEN 1704412800 AND 1706140800
        AND regexp_matches(coalesce(body, ''), '\b(THE|und|les|que)\b', 'i')""",
    "articles",
)
def keyword_filter(t: Tables):
    """Posts of some forums in an epoch range with a keyword, any case."""
    a = t.articles.withColumn("epoch", F.unix_timestamp(C("created_at").cast("timestamp")))
    hit = X.has_keyword(F.coalesce(C("body"), F.lit("")), ["THE", "und", "les", "que"])
    a = a.filter(C("source").isin("src1", "src3", "src5", "src7", "src11")).filter(
        C("epoch").between(1704412800, 1706140800)
    )
    return a.filter(hit).select(
        F.concat_ws("_", C("article_id").cast("string"), "source").alias("article_id"),
        F.concat(F.lit("forum_"), F.lower("source")).alias("source"),
        "created_at",
    )


@query(
    "ticker_corpus",
    """WITH a AS (SELECT c_custkey, upper(trim(c_mktsegment)) AS ticker, c_name FROM customer WHERE upper(trim(c_mktsegment)) IN ('BUILDING', 'MACHINERY')),
       o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate IS NOT NULL),
       d AS (SELECT a.c_name AS article_id, o_orderdate AS created_at, ticker, o_orderkey, o_orderpriority,
             row_number() OVER (PARTITION BY a.c_name ORDER BY o_orderdate, o_orderkey) AS rn FROM a JOIN o ON o_custkey = c_custkey)
       SELECT article_id, created_at, ticker, CASE WHEN o_orderpriority = '1-URGENT' THEN 'aggregator_neutral' ELSE 'mainstream_neutral' END AS bias_tier,
              ((date_trunc('day', created_at)::TIMESTAMP + INTERVAL 1 DAY + INTERVAL 570 MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS t_visible
       FROM d WHERE rn = 1""",
)
def ticker_corpus(t: Tables):
    """Symbol-filtered corpus, first row per id, tier and next-open visibility."""
    cust = t.read("customer").withColumn("ticker", F.upper(F.trim("c_mktsegment")))
    cust = cust.filter(C("ticker").isin("BUILDING", "MACHINERY")).select("c_custkey", "ticker", C("c_name").alias("article_id"))
    rows = t.read("orders").dropna(subset=["o_orderdate"]).join(cust, C("o_custkey") == C("c_custkey"))
    kept = keep_first(
        rows.select("article_id", C("o_orderdate").alias("created_at"), "ticker", "o_orderkey", "o_orderpriority"),
        ["article_id"],
        ["created_at", "o_orderkey"],
    )
    tier = X.map_exact(C("o_orderpriority"), {"1-URGENT": "aggregator_neutral"}, TIER_EXACT_DEFAULT)
    return kept.select(
        "article_id", "created_at", "ticker", tier.alias("bias_tier"), next_open(C("created_at")).alias("t_visible")
    )


@query(
    "json_corpus",
    """WITH j AS (SELECT event_id, event_type, user_id, json_extract(props, '$.k')::BIGINT AS k FROM events)
       SELECT event_id, event_type || '|' || user_id::VARCHAR AS source, (k // 10)::VARCHAR || '|' || (k % 10)::VARCHAR AS symbols
       FROM j WHERE (k // 10) IN (3, 7) OR (k % 10) IN (3, 7)""",
)
def json_corpus(t: Tables):
    """JSON properties parsed once, any-match on the derived tag array."""
    k = F.from_json("props", "k long")["k"]
    tags = F.array(F.floor(C("k") / 10).cast("string"), (C("k") % 10).cast("string"))
    e = t.read("events").select("event_id", "event_type", "user_id", k.alias("k")).withColumn("tags", tags)
    return e.filter(F.exists("tags", lambda x: x.isin("3", "7"))).select(
        "event_id",
        F.concat_ws("|", "event_type", C("user_id").cast("string")).alias("source"),
        F.array_join("tags", "|").alias("symbols"),
    )


@query(
    "coerce_numeric",
    """SELECT p_partkey, try_cast(p_type AS DOUBLE) AS type_num, try_cast(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_num,
              try_cast(p_size::VARCHAR AS DOUBLE) AS size_num FROM part""",
)
def coerce_numeric(t: Tables):
    """Report columns picked by name and coerced; bad cells become NULL."""
    raw = t.read("part").select("p_partkey", C("p_type").alias(" type code"), F.split("p_brand", "#")[1].alias("brand_num_all"), C("p_size").cast("string").alias("size"))
    rep = ingest.clean_header(raw)
    out = ingest.pick_report_columns(rep, exact={"type_num": "type_code", "size_num": "size"}, containing={"brand_num": "brand_num"})
    return out.select("p_partkey", "type_num", "brand_num", "size_num")


@query(
    "unpivot_series",
    """WITH q AS (SELECT 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS label, o_orderstatus AS series, count(*) AS n,
                 sum(o_custkey) AS s FROM orders GROUP BY 1, 2)
       SELECT make_date(right(label, 4)::INT, 3 * substr(label, 2, 1)::INT - 2, 1)::TIMESTAMP AS period, series, value::DOUBLE AS value FROM
        (SELECT label, 'n_' || lower(series) AS series, n AS value FROM q UNION ALL SELECT label, 's_' || lower(series), s FROM q)""",
)
def unpivot_series(t: Tables):
    """Wide quarterly table to long, quarter labels to dates."""
    q = F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit(" "), F.year("o_orderdate"))
    statuses = ("F", "O", "P")
    wide = (
        t.read("orders")
        .groupBy(q.alias("label"))
        .agg(
            *[F.nullif(F.count_if(C("o_orderstatus") == s), F.lit(0)).alias(f"n_{s.lower()}") for s in statuses],
            *[F.sum(F.when(C("o_orderstatus") == s, C("o_custkey"))).alias(f"s_{s.lower()}") for s in statuses],
        )
    )
    cols = [f"{p}_{s.lower()}" for p in "ns" for s in statuses]
    long = ingest.melt_numeric(wide, ["label"], cols)
    return long.select(ingest.quarter_start(C("label")).alias("period"), "series", "value")


_STRIP = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
      '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))"""


@query(
    "html_articles",
    f"""WITH a AS (SELECT page_id, url, {_STRIP.format(x="regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title,
          {_STRIP.format(x="regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")} AS body FROM pages)
        SELECT page_id, url, title, length(body) AS body_chars, md5(body) AS body_md5, NULL::VARCHAR AS published FROM a WHERE title <> ''""",
)
def html_articles(t: Tables):
    """Title, body and publication time of raw pages."""
    html = C("html")
    out = t.read("pages").select(
        "page_id", "url", X.html_title(html).alias("title"), X.html_body(html, paragraphs=30).alias("body"), X.html_published(html).alias("published")
    )
    return out.filter(C("title").isNotNull()).select(
        "page_id", "url", "title", F.length("body").cast("long").alias("body_chars"), F.md5("body").alias("body_md5"), "published"
    )


@query(
    "html_links",
    r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
                 unnest(regexp_extract_all(html, '(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS label FROM pages)
       SELECT page_id, label AS title, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href
              WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href
              ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://.*/)', 1) || href END AS link FROM l""",
)
def html_links(t: Tables):
    """Links of a page with relative addresses resolved."""
    links = t.read("pages").select("page_id", "url", F.explode(X.html_anchors(C("html"))).alias("a"))
    return links.select("page_id", C("a.label").alias("title"), X.resolve_url(C("url"), C("a.href")).alias("link"))


@query(
    "incremental_upsert",
    """WITH e AS (SELECT article_id, source, lang, created_at FROM articles WHERE lang = 'en'),
            i AS (SELECT article_id, 'refetched' AS source, lang, created_at FROM articles WHERE created_at >= TIMESTAMP '2024-01-10')
       SELECT * FROM e UNION ALL SELECT * FROM i ANTI JOIN e USING (article_id)""",
    "articles",
)
def incremental_upsert(t: Tables):
    """Merge a new pull into the stored articles, stored rows win."""
    cols = ["article_id", "source", "lang", "created_at"]
    stored = t.article_times.filter(C("lang") == "en").select(*cols)
    pull = t.article_times.filter(C("created_at") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    pull = pull.withColumn("source", F.lit("refetched")).select(*cols)
    return ingest.incremental_upsert(stored, pull.unionByName(pull), ["article_id"])


@query("settled_days", "SELECT symbol, bar_open, close FROM daily WHERE bar_open::DATE < DATE '2000-01-01'", "daily")
def settled_days(t: Tables):
    """Daily bars that were final at an as-of date."""
    return ingest.settled_days(t.daily, "bar_open", "2000-01-01").select("symbol", "bar_open", "close")


@query(
    "ohlcv_bars",
    "SELECT symbol, bar_open, bar_close, open, high, low, close, volume, round(vwap, 8) AS vwap FROM bars",
    "bars",
)
def ohlcv_bars(t: Tables):
    """Hourly bars built from ticks."""
    return t.bars.select(
        "symbol", "bar_open", "bar_close", "open", "high", "low", "close", "volume", rnd(C("vwap"), 8).alias("vwap")
    )


@query(
    "null_profile",
    """WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
       SELECT 'doc_id' AS "column", round(count(doc_id) / count(*), 6) AS non_null_share, count(*) AS n_rows FROM j
       UNION ALL SELECT 'lang', round(count(lang) / count(*), 6), count(*) FROM j
       UNION ALL SELECT 'quality', round(count(quality) / count(*), 6), count(*) FROM j
       UNION ALL SELECT 'toxic', round(count(toxic) / count(*), 6), count(*) FROM j""",
)
def null_profile(t: Tables):
    """Share of non-null cells per column."""
    j = t.read("documents").select("doc_id", "lang").join(t.read("labels"), "doc_id", "left")
    p = ingest.null_profile(j, ["doc_id", "lang", "quality", "toxic"])
    return p.select("column", rnd(C("non_null_share")).alias("non_null_share"), "n_rows")


@query("file_integrity")
def file_integrity(t: Tables):
    """Hash tree of every file of the tables, read in byte ranges (no SQL reads raw bytes)."""
    files = snapshot.integrity_manifest(t.spark, t.path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "size", "n_blocks", "sha256")


@query("cursor_ingest", "SELECT event_id, ts, event_type, value FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL")
def cursor_ingest(t: Tables):
    """All ticks through the cursor source: a task a day, page by page in (time, id) order."""
    args = {"path": f"{t.path}/events.parquet", "time": "ts", "id": "event_id", "columns": ["event_type", "value"]}
    return cursor.read_feed(t.spark, cursor.TableFeed, args).select("event_id", "ts", "event_type", "value")
