"""URL filters by a sort-merge range join of urls with nested rules.

A host becomes its labels in reverse order, each ended by a dot, so that a rule's host and all subdomains form one
interval of keys; paths are intervals already. Two sorted sweeps resolve a url: the first, over hosts, gives the stack of
rule hosts around it; the second, over (innermost rule host, path), gives the stack of rules whose host and path fit.
Intervals of prefixes are nested, so each begin or end of an interval carries the stack that holds after it, and a url
takes the stack of the last such event before it. Rows are dealt by range with the row's own id as the last key, so a
host with a third of all urls is cut at any place; a stack that is open where a partition ends is carried on over a
table with one row for each partition.

Defined cases: a null url, or one without `://`, has an empty host and path and meets no rule. A host label may be
empty. Of the rules that fit, the one with the longest host and path together wins, then the longest host, then `block`.
Repeated rows get one result each; an empty table of pages or rules gives no row or no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.llm.common import lower_ascii, stored, table

#: The rules of the contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
RULE_SCHEMA = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """`www.example.com` as `com.example.www.`."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _after(key: Column) -> Column:
    """The end of the interval of all strings that begin with `key`: no UTF-8 text holds byte FF."""
    return F.concat(key.cast("binary"), F.lit(bytearray(b"\xff")))


def _label_prefixes(key: Column) -> Column:
    """`com.example.www.` as [`com.`, `com.example.`, `com.example.www.`]."""
    labels = F.split(F.substring(key, F.lit(1), F.length(key) - 1), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))


def sweep(events: DataFrame, points: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """`points` with the `stack` of the last event at or before them. `events` has `keys` and `stack`, `points` has
    `keys` and the columns `rest`, of which the first tells equal keys apart."""
    kinds = {c: points.schema[c].dataType for c in rest}
    stack = events.schema["stack"].dataType
    both = events.select(*keys, F.lit(0).alias("kind"), *[F.lit(None).cast(kinds[c]).alias(c) for c in rest], "stack").unionByName(
        points.select(*keys, F.lit(1).alias("kind"), *rest, F.lit(None).cast(stack).alias("stack"))
    )
    order = [*keys, "kind", rest[0]]
    laid = stored(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    laid = laid.withColumn("part", F.shiftright("at", 33))
    ends = laid.filter(F.col("stack").isNotNull()).groupBy("part").agg(F.max_by("stack", "at").alias("open"))
    ends = laid.groupBy("part").count().select("part").join(ends, "part", "left")
    carried = ends.select("part", F.last("open", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.last("stack", ignorenulls=True).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    # one row for each partition, so the table is small whatever the input
    met = laid.withColumn("own", own).filter(F.col("kind") == 1).join(F.broadcast(carried), "part", "left")
    return met.select(*keys, *rest, F.coalesce("own", "carried").alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """`urls` has page_id and url, `rules` has host, path and verdict. One row for each url: page_id, host, path, rule, verdict."""
    rules = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select("host", "path", "verdict", host_key(F.col("host")).alias("hk"))
        .withColumn("entry", F.struct((F.length("host") + F.length("path")).alias("total"), F.length("host").alias("host_points"), "verdict", F.concat("host", "path").alias("rule")))
    )
    # the rule hosts around each rule host, outermost first
    hosts = rules.select("hk").distinct()
    chain = hosts.select("hk", F.explode(_label_prefixes(F.col("hk"))).alias("outer")).join(hosts.select(F.col("hk").alias("outer")), "outer")
    chain = chain.groupBy("hk").agg(F.array_sort(F.collect_set("outer")).alias("chain"))
    begins = chain.select(F.col("hk").cast("binary").alias("key"), F.col("chain").alias("stack"))
    finishes = chain.select(_after(F.col("hk")).alias("key"), F.slice("chain", F.lit(1), F.size("chain") - 1).alias("stack"))
    host, path = split_url(F.col("url"))
    points = urls.select(F.monotonically_increasing_id().alias("rid"), "page_id", host.alias("host"), path.alias("path"))
    points = points.withColumn("key", host_key(F.col("host")).cast("binary"))
    around = sweep(begins.unionByName(finishes), points, ["key"], ["rid", "page_id", "host", "path"])
    around = around.withColumn("top", F.coalesce(F.element_at("stack", F.when(F.size("stack") > 0, -1)), F.lit("")))

    # the rules that hold inside each rule host, its own and those of the hosts around it
    inside = chain.select("hk", F.explode("chain").alias("outer")).join(rules.select(F.col("hk").alias("outer"), "path", "entry"), "outer").select("hk", "path", "entry")
    best = inside.groupBy("hk", "path").agg(F.max("entry").alias("entry"))
    prefix = best.select("hk", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).withColumn("outer_path", F.expr("left(path, n)"))
    nested = prefix.join(best.select("hk", F.col("path").alias("outer_path"), F.col("entry").alias("outer_entry")), ["hk", "outer_path"])
    nested = nested.groupBy("hk", "path").agg(F.array_sort(F.collect_list(F.struct("n", "outer_entry"))).alias("s"))
    nested = nested.select("hk", "path", F.transform("s", lambda x: x["outer_entry"]).alias("s"))
    begins = nested.select(F.col("hk").alias("top"), F.col("path").cast("binary").alias("key"), F.col("s").alias("stack"))
    finishes = nested.select(F.col("hk").alias("top"), _after(F.col("path")).alias("key"), F.slice("s", F.lit(1), F.size("s") - 1).alias("stack"))
    # a stack doesn't reach into the next rule host
    cleared = nested.select(F.col("hk").alias("top")).distinct().select("top", F.lit(bytearray(b"\xff\xff")).alias("key"), F.array().cast(nested.schema["s"].dataType).alias("stack"))
    points = around.select("rid", "page_id", "host", "path", "top", F.col("path").cast("binary").alias("key"))
    met = sweep(begins.unionByName(finishes).unionByName(cleared), points, ["top", "key"], ["rid", "page_id", "host", "path"])
    won = F.array_max("stack")
    return met.select("page_id", "host", "path", won["rule"].alias("rule"), F.coalesce(won["verdict"], F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
