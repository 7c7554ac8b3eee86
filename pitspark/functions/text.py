"""Text, JSON and HTML expressions; no Python in the row path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitspark.functions.fixed import FEATURE_TOKENS


def any_pattern(text: Column, families: Mapping[str, str]) -> Column:
    """True when any family of patterns occurs."""
    return text.rlike("|".join(f"(?:{p})" for p in families.values()))


def has_keyword(text: Column, words: Sequence[str]) -> Column:
    """Whole-word match of any keyword, any case. Word boundaries are ASCII, so
    an accented letter ends a word whatever regex flavour the JVM ships."""
    edge = "[A-Za-z0-9_]"
    return text.rlike(f"(?i)(?<!{edge})(?:{'|'.join(words)})(?!{edge})")


def pattern_flags(text: Column, families: Mapping[str, str]) -> dict[str, Column]:
    return {name: F.coalesce(text.rlike(p), F.lit(False)) for name, p in families.items()}


def contains_ci(text: Column, needle: str) -> Column:
    """Case-insensitive literal substring."""
    return F.lower(text).contains(needle.lower())


def map_exact(key: Column, table: Mapping[str, str], default: str) -> Column:
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*entries), key), F.lit(default))


def map_first_substring(text: Column, table: Mapping[str, str], default: str) -> Column:
    """Value of the first entry, in table order, whose key occurs in the text."""
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(text.contains(key), F.lit(value)).otherwise(out)
    return out


def feature_category(name: Column) -> Column:
    """Category of a feature name: the first token family that occurs in it."""
    low = F.lower(name)
    out = F.lit("other")
    for cat, tokens in reversed(list(FEATURE_TOKENS.items())):
        hit = low.contains(tokens[0])
        for tok in tokens[1:]:
            hit = hit | low.contains(tok)
        out = F.when(hit, F.lit(cat)).otherwise(out)
    return out


def article_text(title: Column, body: Column, body_chars: int | None = None) -> Column:
    """Title, blank line, body (its first ``body_chars`` characters, if given);
    NULL when both are empty."""
    head = F.nullif(F.trim(title), F.lit(""))
    whole = F.trim(F.coalesce(body, F.lit("")))
    rest = F.nullif(whole if body_chars is None else F.substring(whole, 1, body_chars), F.lit(""))
    return F.nullif(F.concat_ws("\n\n", head, rest), F.lit(""))


def row_key(*parts: Column) -> Column:
    """Stable id of a row from its identifying parts."""
    return F.sha2(F.concat_ws("|", *parts), 256)


_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def strip_tags(html: Column) -> Column:
    """Visible text of a fragment: scripts, styles, comments and tags removed,
    common entities decoded, white space collapsed."""
    out = html
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>"):
        out = F.regexp_replace(out, p, " ")
    for k, v in _ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def _first(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def html_title(html: Column) -> Column:
    """First h1, else the og:title of the page head."""
    h1 = strip_tags(_first(html, r"(?is)<h1[^>]*>(.*?)</h1>"))
    og = F.trim(_first(html, r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"'))
    return F.coalesce(F.nullif(h1, F.lit("")), og)


def html_body(html: Column, paragraphs: int | None = None) -> Column:
    """Text of the article element, else of the (first ``paragraphs``) paragraphs."""
    article = strip_tags(_first(html, r"(?is)<article[^>]*>(.*?)</article>"))
    paras = F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    paras = paras if paragraphs is None else F.slice(paras, 1, paragraphs)
    return F.coalesce(F.nullif(article, F.lit("")), F.nullif(strip_tags(F.array_join(paras, " ")), F.lit("")))


def html_published(html: Column) -> Column:
    """Publication time as written: time element, else the published meta tag."""
    t = _first(html, r'(?is)<time[^>]*datetime="([^"]*)"')
    m = _first(html, r'(?is)<meta[^>]*property="article:published_time"[^>]*content="([^"]*)"')
    return F.coalesce(t, m)


def html_anchors(html: Column) -> Column:
    """Array of (href, label) of all links."""
    pattern = r'(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    return F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"),
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page."""
    root = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-z]+://.*/)", 1)
    return (
        F.when(href.rlike(r"^[a-z]+://"), href)
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )


def published_fallback(page_meta: Column, url: Column, capture: Column) -> Column:
    """Page metadata, else a date in the address, else the capture time."""
    slug = F.nullif(F.regexp_extract(url, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(
        F.try_to_timestamp(page_meta).cast("timestamp_ntz"),
        F.try_to_timestamp(slug).cast("timestamp_ntz"),
        F.try_to_timestamp(capture, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"),
    )


def any_member(values: Column, wanted: Sequence) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(v) for v in wanted]))
