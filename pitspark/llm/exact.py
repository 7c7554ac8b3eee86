"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition becomes a run: its distinct digests in order, each with the best row and the number of rows. Runs
meet in rounds of a k-nomial tree: in round r the nodes whose number differs only in the r-th base-`fan_in` digit merge
into one. A run is dealt over `lanes` by digest, so that a merge holds one lane of `fan_in` runs, never a whole run.
After the last round one sorted run is left; its entries go back to the partitions' distinct digests, and from there to
the rows, so that a text with any number of copies costs one row for each partition.

Defined cases: a null text equals an empty one, and texts of white space only equal both. Of rows that agree in text and
doc_id exactly one stays. A null doc_id ranks behind all others. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import fresh, keyed_texts, stored, table, texts_of, with_row_id

WHITE = " \t\n\x0b\x0c\r"


def digests(texts: DataFrame) -> DataFrame:
    """(rid, node, doc_id, digest, n_norm, n_points) of every row of `texts` (rid, doc_id, text)."""
    text = F.col("text")
    norm = F.translate(text, WHITE, "")
    return texts.select(
        "rid",
        F.spark_partition_id().cast("long").alias("node"),
        "doc_id",
        F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"),
        F.octet_length(norm).cast("long").alias("n_norm"),
        F.char_length(text).cast("long").alias("n_points"),
    )


def _merge(run: pa.Table) -> pa.Table:
    """Merge the runs of one node and lane: equal digests become one entry with the best row and the sum of rows.

    Entries with one digest must agree in the length of their normalised text; else the digest has failed.
    """
    n = run.num_rows
    digest = np.frombuffer(b"".join(run["digest"].to_pylist()), dtype=">u8").reshape(n, 4)
    points = run["n_points"].to_numpy()
    rank = pa.compute.rank(run["doc_id"], sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
    order = np.lexsort((run["rid"].to_numpy(), rank, -points, digest[:, 3], digest[:, 2], digest[:, 1], digest[:, 0]))
    run, digest = run.take(order), digest[order]
    first = np.concatenate(([True], (digest[1:] != digest[:-1]).any(axis=1)))
    at = np.flatnonzero(first)
    length = run["n_norm"].to_numpy()
    if (length != length[at][np.cumsum(first) - 1]).any():
        raise ValueError("two texts of different lengths have one digest")
    out = run.take(at)
    return out.set_column(out.schema.get_field_index("size"), "size", pa.array(np.add.reduceat(run["size"].to_numpy(), at), pa.int64()))


def assign(docs: DataFrame, fan_in: int = 8, lane_rows: int = 200_000) -> DataFrame:
    """One row for each input row: rid, doc_id, digest, keep_rid, keep_id, group_size.

    `fan_in` is the number of runs that meet in a round, `lane_rows` about how many entries a lane of the last run has.
    """
    return assign_texts(keyed_texts(docs), fan_in, lane_rows)


def assign_texts(texts: DataFrame, fan_in: int = 8, lane_rows: int = 200_000) -> DataFrame:
    """`assign` for rows with numbers: rid, doc_id and text."""
    rows = stored(digests(texts))
    total, nodes = rows.agg(F.count("*"), F.coalesce(F.max("node"), F.lit(0)) + 1).first()
    lanes = max(1, -(-total // lane_rows), min(total // 64, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("best")
    local = rows.groupBy("node", "digest").agg(best, F.count("*").alias("size"), F.min("n_norm").alias("n_norm"), F.max("n_norm").alias("most"))
    local = local.withColumn("n_norm", F.when(F.col("n_norm") == F.col("most"), F.col("n_norm")).otherwise(F.raise_error(F.lit("two texts of different lengths have one digest"))))
    lane = F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(lanes))
    run = local.select("node", lane.alias("lane"), "digest", "n_norm", (-F.col("best.p")).alias("n_points"), "best.doc_id", "best.rid", "size")
    schema = run.schema
    left = nodes
    while True:
        run = run.withColumn("node", F.floor(F.col("node") / fan_in).cast("long")).groupBy("node", "lane").applyInArrow(_merge, schema)
        left = -(-left // fan_in)
        if left <= 1:
            break
    won = run.select("digest", F.col("rid").alias("keep_rid"), F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size"))
    won = local.select("node", "digest").join(won, "digest")
    return rows.select("rid", "node", "doc_id", "digest").join(won, ["node", "digest"]).select("rid", "doc_id", "digest", "keep_rid", "keep_id", "group_size")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    row = fresh(docs.columns, "row")
    rows = with_row_id(docs, row)
    kept = assign_texts(texts_of(rows, row)).filter(F.col("rid") == F.col("keep_rid")).select(F.col("rid").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
), n AS (
  SELECT doc_id, length(body) AS points, sha256(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM n
"""
