"""Near-duplicate documents by a MinHash LSH forest, with every link confirmed on the full shingle sets.

Documents with one shingle set are one node. Each tree of the forest sorts the nodes by its own order of signature
values. A node's candidates are its neighbours in the order, with which it shares the longest prefix; a prefix shorter
than `depth` is none. In a region where many nodes share a prefix, neighbours share more of it, so the depth follows the
density. That links all but a few nodes of a group without forming its pairs. What neighbours cannot show is then found
exactly: in a region (nodes of a tree with an equal prefix of `depth` values) that still has nodes of several components,
each node outside the largest one is compared with every node of the region, in blocks of bounded size. So two documents
stay apart only if they share no region, which for a similarity of 0.85 has a probability of (1 - 0.85**depth)**trees,
below 1e-5.

Words are maximal runs without white space; A-Z are lower-cased. A shingle is five words; fewer words are one shingle.

Defined cases: a document without words (null, empty, white space) has an empty set and no link. Repeated rows are copies
of each other. Null doc_ids count as larger than any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitspark.llm import features
from pitspark.llm.common import fresh, keyed_texts, slices, stored, table, texts_of, with_row_id
from pitspark.llm.components import components

SHINGLE = 5
TREES, DEPTH, DEEPEST = 20, 5, 10
VALUES = TREES * DEPTH
CHAINED = 3  # trees whose neighbours are linked first
FILTER_BITS = 24  # of the filter that thins a scan before it is joined; 2 MB whatever the input
LINK = (85, 100)
_STEP = np.array([pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    parts: dict[int, list[np.ndarray]] = {}
    last, length = 0, 0  # hash and length of the last word so far
    for block in features.blocks(texts):
        upper = (block.codes >= 65) & (block.codes <= 90)
        block.codes[upper] += 32
        hashes, starts, ends = features.words(block)
        if block.joins:
            own = parts[int(block.rows[0])]
            own[-1] = own[-1][:-1]
            hashes[0] = features.joined_hash(last, length, int(hashes[0]))
        if len(hashes):
            last, length = int(hashes[-1]), int(ends[-1] - starts[-1]) + (length if block.joins and len(hashes) == 1 else 0)
        hashes = _mix(hashes)
        cuts = np.searchsorted(starts, np.append(block.starts, block.ends[-1]))
        for row, a, b in zip(block.rows.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            parts.setdefault(row, []).append(hashes[a:b])
    out = []
    for row in range(len(texts)):
        found = parts.get(row, [])
        w = found[0] if len(found) == 1 else np.concatenate(found) if found else np.empty(0, np.uint64)
        if not len(w):
            out.append(w)
        elif len(w) < SHINGLE:
            out.append(_mix((w * _STEP[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w))))
        else:
            n = len(w) - SHINGLE + 1
            h = w[:n] * _STEP[0]
            for k in range(1, SHINGLE):
                h += w[k : k + n] * _STEP[k]
            out.append(np.unique(_mix(h)))
    return out


def signature(hashes: np.ndarray, rows: int = 4096) -> np.ndarray:
    """The smallest of the permuted values for each of `VALUES` permutations."""
    a, b = _constants()
    low = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), rows):
        np.minimum(low, ((short[at : at + rows, None] ^ b) * a).min(axis=0), out=low)
    return low


def signatures(docs: DataFrame) -> DataFrame:
    """`docs` (rid, doc_id, text) as rid, doc_id, n (set size), digest of the set, signature (16 bits a value, big-endian)."""
    schema = T.StructType([T.StructField("rid", T.LongType()), docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())])

    def run(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist())
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sign = [(signature(s) >> np.uint32(16)).astype(">u2").tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sign, pa.binary())], names=[f.name for f in schema])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, schema)


def _tree_rows(nodes: DataFrame) -> DataFrame:
    """(tree, key, rid): the node's values in the tree's order, `DEEPEST` of them."""
    orders = [np.arange(t * DEPTH, t * DEPTH + DEEPEST) % VALUES for t in range(TREES)]
    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("rid", T.LongType())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=">u2").reshape(n, VALUES)
            for t, order in enumerate(orders):
                keys = np.ascontiguousarray(sign[:, order]).tobytes()
                size = 2 * DEEPEST
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array([keys[i * size : (i + 1) * size] for i in range(n)], pa.binary()), batch.column("rid")], names=["tree", "key", "rid"])

    return nodes.select("rid", "signature").mapInArrow(run, schema)


def forest(nodes: DataFrame) -> DataFrame:
    """The members of regions: tree, prefix, rid, next (the neighbour behind it in the order; null at a region's end).

    The orders are sorted by range, with the node itself as the last key, so a region of any size is cut at any place.
    A partition's first and last rows are always kept and joined with those of the partitions around it.
    """
    order = ["tree", "key", "rid"]
    laid = _tree_rows(nodes).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("prefix", T.BinaryType()), T.StructField("rid", T.LongType()), T.StructField("next", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("edge", T.IntegerType())])
    size = 2 * DEPTH

    def run(batches):
        held = None  # (tree, key, rid, linked before, first)
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], names=[f.name for f in schema])

        for batch in batches:
            for tree, key, rid in zip(batch.column("tree").to_pylist(), batch.column("key").to_pylist(), batch.column("rid").to_pylist(), strict=True):
                near = False
                if held is not None:
                    near = held[0] == tree and held[1][:size] == key[:size]
                    if near or held[3] or held[4]:
                        out.append((held[0], held[1][:size], held[2], rid if near else None, held[1] if held[4] else None, 1 if held[4] else 0))
                held = (tree, key, rid, near, held is None)
            yield flush()
            out = []
        if held is not None:
            out.append((held[0], held[1][:size], held[2], None, held[1], 3 if held[4] else 2))
            yield flush()

    rows = stored(laid.mapInArrow(run, schema))
    # first and last rows of the partitions: two for each partition
    edges = rows.filter(F.col("edge") > 0).withColumn("last", F.col("edge") >= 2)
    w = Window.orderBy("tree", "key", "rid")
    ahead = edges.select("tree", "prefix", "rid", "last", F.lead("tree").over(w).alias("t"), F.lead("prefix").over(w).alias("p"), F.lead("rid").over(w).alias("r"))
    ahead = ahead.filter(F.col("last") & (F.col("t") == F.col("tree")) & (F.col("p") == F.col("prefix"))).select("tree", "rid", F.col("r").alias("ahead"))
    rows = rows.join(F.broadcast(ahead), ["tree", "rid"], "left").select("tree", "prefix", "rid", F.coalesce("next", "ahead").alias("next"))
    shared = rows.groupBy("tree", "prefix").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    return stored(rows.join(stored(shared), ["tree", "prefix"]))


def _filter_words(members: DataFrame) -> np.ndarray:
    """A bit for the hash of each member: at most 2**FILTER_BITS / 64 rows come to the driver."""
    bit = F.shiftrightunsigned(F.xxhash64("rid"), 64 - FILTER_BITS)
    got = members.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("v")).toPandas()
    words = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    words[got["w"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64)
    return words


def _thinned(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members' rows and few others: a fixed-size filter spares most texts the shuffle of the join."""
    words = _filter_words(members)
    schema = T.StructType([T.StructField("bit", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            yield batch.filter(pa.array(((words[bit >> 6] >> (bit & 63)) & 1).astype(bool)))

    bit = F.shiftrightunsigned(F.xxhash64("rid"), 64 - FILTER_BITS).alias("bit")
    return docs.select(bit, "rid", "text").mapInArrow(run, schema).drop("bit")


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(rid, n, hashes) of the documents that are in a region."""
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType())])

    def run(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "n", "hashes"])

    return stored(_thinned(docs, members).join(members, "rid", "left_semi").select("rid", "text").mapInArrow(run, schema))


def _is_link(both, either):
    return LINK[1] * both >= LINK[0] * either


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("hashes").alias(f"set_{x}"))
    fits = (LINK[0] * F.greatest("n_a", "n_b")) <= LINK[1] * F.least("n_a", "n_b")
    sizes = sets.select("rid", "n")
    kept = pairs.join(sizes.select(F.col("rid").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("rid").alias("b"), F.col("n").alias("n_b")), "b").filter(fits).select("a", "b")
    joined = kept.join(side("a").drop("n_a"), "a").join(side("b").drop("n_b"), "b").select("a", "b", "set_a", "set_b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        for batch in slices(batches, "set_a", "set_b"):
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(_is_link(both, len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, schema)


def _block_links(group: pa.Table) -> pa.Table:
    """Components that links between the asking and the asked nodes of one block join: a spanning forest of them, so
    fewer rows than the block has components."""
    ask, asked = group.filter(group["asks"]), group.filter(pa.compute.invert(group["asks"]))
    own = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in asked["hashes"]]
    size = np.array([len(s) for s in own], dtype=np.int64)
    a, b = [], []
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    if ask.num_rows and asked.num_rows:
        flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        comp = asked["component"].to_numpy()
        for x, c in zip(ask["hashes"], ask["component"].to_pylist(), strict=True):
            q = np.frombuffer(x.as_buffer(), dtype=np.uint64)
            low, high = np.searchsorted(flat, q, "left"), np.searchsorted(flat, q, "right")
            reach = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(reach)[:-1])), reach) + np.arange(reach.sum())
            both = np.bincount(owner[at], minlength=len(own))
            hit = np.flatnonzero(_is_link(both, size + len(q) - both) & (comp != c))
            for other in np.unique(comp[hit]).tolist():
                mine, its = root(c), root(other)
                if mine != its:
                    above[mine] = its
                    a.append(c)
                    b.append(other)
    return pa.table({"from": pa.array(a, pa.int64()), "to": pa.array(b, pa.int64())})


def _across(regions: DataFrame, comp: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(from, to): components joined by links between nodes that share a region but no component yet."""
    member = regions.select("tree", "prefix", "rid").join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    member = stored(member.join(sets.select("rid", "n"), "rid"))
    who = F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("who")
    per = member.groupBy("tree", "prefix", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"), who)
    mixed = per.groupBy("tree", "prefix").agg(F.count("*").alias("parts"), F.sum("k").alias("size"), F.sum("who").alias("who"), F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("n").alias("n"), F.max_by("n", F.struct("k", "component")).alias("n_main")).filter(F.col("parts") > 1)
    # of regions with the same members, one is enough
    mixed = mixed.groupBy("size", "who").agg(F.min(F.struct("tree", "prefix", "main", "n", "n_main")).alias("one")).select("one.*")
    blocks = lambda n: F.ceil(n / block).cast("int")
    mixed = stored(mixed.select("tree", "prefix", "main", blocks(F.col("n")).alias("asked_blocks"), blocks(F.col("n") - F.col("n_main")).alias("ask_blocks")))
    inside = member.join(mixed, ["tree", "prefix"])
    place = lambda n, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = inside.select("tree", "prefix", "rid", "component", F.lit(False).alias("asks"), place(F.col("asked_blocks"), 1).alias("i"), every(F.col("ask_blocks")).alias("j"))
    asks = inside.filter(F.col("component") != F.col("main")).select("tree", "prefix", "rid", "component", F.lit(True).alias("asks"), place(F.col("ask_blocks"), 2).alias("j"), every(F.col("asked_blocks")).alias("i"))
    rows = asked.unionByName(asks).join(sets.select("rid", "hashes"), "rid")
    return rows.groupBy("tree", "prefix", "i", "j").applyInArrow(_block_links, "from long, to long")


def near_groups(docs: DataFrame, block: int = 200_000) -> DataFrame:
    """One row for each row of `docs`: rid, doc_id, n_shingles, component_rid, component_id (the smallest doc_id reachable).

    `block` bounds the shingles on either side of a comparison block (one document may be larger).
    """
    return groups_of_texts(keyed_texts(docs), block)


def groups_of_texts(texts: DataFrame, block: int = 200_000) -> DataFrame:
    """`near_groups` for rows with numbers: rid, doc_id and text."""
    signed = stored(signatures(texts).withColumn("node", F.spark_partition_id()))
    full = signed.filter(F.col("n") > 0)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("first")
    local = stored(full.groupBy("node", "digest").agg(first))  # copies meet here first: at most one row for each partition goes on
    heads = stored(local.groupBy("digest").agg(F.min("first").alias("head")).select("digest", "head.rid", "head.doc_id"))
    regions = forest(full.join(heads.select("rid"), "rid", "left_semi"))
    sets = _sets(texts, stored(regions.select("rid").distinct()))
    near = regions.filter((F.col("tree") < CHAINED) & F.col("next").isNotNull())
    pairs = near.select(F.least("rid", "next").alias("a"), F.greatest("rid", "next").alias("b")).distinct()
    comp = stored(components(_confirm(stored(pairs), sets)))
    # links across components join whole components, so only these are linked from here on
    more = stored(_across(regions, comp, sets, block).select(F.col("from").alias("a"), F.col("to").alias("b")).distinct())
    whole = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    alone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti").select("node", F.col("node").alias("component"))
    comp = stored(comp.unionByName(alone).join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))
    named = heads.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = stored(named)
    smallest = stored(named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("s")))
    named = stored(named.join(smallest, "component").select("digest", F.col("s.rid").alias("component_rid"), F.col("s.doc_id").alias("component_id")))
    to_local = local.select("node", "digest").join(named, "digest")
    out = signed.select("rid", "node", "doc_id", "n", "digest").join(to_local, ["node", "digest"], "left")
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_rid", "rid").alias("component_rid"), F.when(F.col("component_rid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group, with all columns."""
    row = fresh(docs.columns, "row")
    rows = with_row_id(docs, row)
    kept = groups_of_texts(texts_of(rows, row)).filter(F.col("rid") == F.col("component_rid")).select(F.col("rid").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0))
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
