"""Exact and near deduplication and substring removal against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pitspark.llm import components, exact, nearmatch, substrings

LAST = 1 << 70


def rank(doc_id):
    return LAST if doc_id is None else doc_id


def norm(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def check_exact(docs):
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r)
    want = Counter()
    for key, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), rank(r.doc_id)))
        for r in members:
            want[(r.doc_id, best.doc_id, len(members), hashlib.sha256(key.encode()).hexdigest())] += 1
    got = exact.assign(docs, fan_in=2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got) == want
    kept = Counter(r.digest.hex() for r in got if r.rid == r.keep_rid)
    assert set(kept.values()) <= {1} and len(kept) == len(groups)
    return groups


def test_exact_on_odd_rows(tricky):
    groups = check_exact(tricky)
    kept = exact.keep_first(tricky)
    assert kept.columns == tricky.columns and kept.count() == len(groups)


def test_exact_on_an_empty_table(empty):
    assert exact.assign(empty).count() == 0 and exact.keep_first(empty).columns == empty.columns


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_classes(rows):
    """By brute force: for each row its set size and the smallest doc_id reachable."""
    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (LAST, None)), (rank(r.doc_id), 0), key=lambda x: x[0])
    return [(r.doc_id, len(s), None if least[root(i)][0] == LAST else least[root(i)][0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_near_on_odd_rows(tricky):
    # a word beyond the block size is read as several words; the brute force isn't
    docs = tricky.filter("doc_id is null or doc_id <> 32")
    want = near_classes(docs.select("doc_id", "text").collect())
    got = nearmatch.near_groups(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    kept = [r for r in got if r.rid == r.component_rid]
    assert len({r.component_rid for r in got}) == len(kept)
    assert nearmatch.keep_one(docs).columns == docs.columns


def test_near_needs_the_comparison_inside_regions(spark, tmp_path):
    """Chains of edits: neighbours are linked, ends are not; blocks of a few shingles force many of them."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        w = list(words)
        for k in range(i):
            w[(k * 37) % 400] = f"edit{k}"
        rows.append((1000 - i, " ".join(w)))
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    got = nearmatch.near_groups(docs, block=1500).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(near_classes(docs.collect()))


def test_near_on_an_empty_table(empty):
    assert nearmatch.near_groups(empty).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    order = [(i * 7919) % 1009 for i in range(n)]
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(5000, 5001), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert {got[x] for x in order} == {min(order)} and got[5001] == got[5000] == 5000


def test_few_links_take_few_jobs(spark):
    """Rounds on few links were more than a hundred small jobs."""
    n = 300
    order = [(i * 7919) % 1009 for i in range(n)]
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        assert components.components(links).count() == n
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 12


def test_components_of_many_pieces(spark):
    rng = random.Random(11)
    links = [(rng.randrange(-500, 3000), rng.randrange(-500, 3000)) for _ in range(1500)] + [(9000 + (i * 77) % 401, 9000 + ((i + 1) * 77) % 401) for i in range(400)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for pair in links if pair[0] != pair[1] for x in pair}
    df = spark.createDataFrame(links, "a long, b long")
    for most in (1 << 18, 100):
        got = components.components(df, most).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.components(df.limit(0)).count() == 0


def stripped(rows):
    """By brute force: removed bytes of each row."""
    first = {}
    data = [(rank(r.doc_id), (r.text or "").encode()) for r in rows]
    for d, b in data:
        for i in range(len(b) - 49):
            key = b[i : i + 50]
            first[key] = min(first.get(key, LAST + 1), d)
    out = Counter()
    for r, (d, b) in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[(r.doc_id, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    return out


def test_substrings_on_odd_rows(tricky):
    got = substrings.strip(tricky).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == stripped(tricky.select("doc_id", "text").collect())


def test_substrings_on_small_alphabets(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab") for _ in range(6)) * rng.randint(0, 30) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 80)))) for i in range(300)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    got = substrings.strip(docs, with_text=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == stripped(docs.collect())
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got)
    cut = substrings.cut_spans(substrings.keyed_texts(docs), batch_bytes=2000, lane_names=500)
    want = {r.rid: r.n_removed for r in got if r.n_removed}
    import numpy as np

    assert {r.rid: int((np.frombuffer(r.ends, np.int64) - np.frombuffer(r.starts, np.int64)).sum()) for r in cut.collect()} == want


def test_substrings_on_an_empty_table(empty):
    assert substrings.strip(empty).count() == 0
