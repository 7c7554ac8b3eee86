"""URL rules and decontamination against brute force."""

import random
import re
from collections import Counter

from pitspark.llm import decontam, urlrules

RULE = "host string, path string, verdict string"


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


def test_urls_by_brute_force(spark, tmp_path):
    rng = random.Random(2)
    part = lambda n: ".".join(rng.choice(["a", "b", "com", "", "é"]) for _ in range(rng.randint(0, n)))
    path = lambda: "/" + "/".join(rng.choice(["x", "xy", "y", ""]) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((part(3), rng.choice([path(), ""])) for _ in range(60)) if h}.values())
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{part(4)}{rng.choice([path(), ''])}{rng.choice(['', '?q=/x', '#/x'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "http://", "http://A.COM", "x://y://a.com/x", "http://com/x", "http://com/x"]
    file = str(tmp_path / "p.parquet")
    spark.createDataFrame([(i if i % 50 else None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, stack string").repartition(3).write.parquet(file)
    got = urlrules.judge(spark.read.parquet(file), spark.createDataFrame(rules, RULE)).collect()
    want = Counter((i if i % 50 else None, *judged(u, rules)) for i, u in enumerate(urls))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want


def test_no_rules_and_no_urls(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block")], RULE)
    assert [r.verdict for r in urlrules.judge(pages, spark.createDataFrame([], RULE)).collect()] == ["allow"]
    assert urlrules.judge(none, rules).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def hits(rows, items, size=13):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = Counter()
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out[(doc_id, len(w), len(hit), tuple(sorted(found)))] += 1
    return out


def test_decontamination_by_brute_force(spark, tricky, tmp_path):
    texts = {r.doc_id: r.text for r in tricky.collect() if r.text}
    cut = lambda d, a, b: " ".join(words(texts[d])[a:b])
    items = [(10, cut(5, 20, 60)), (2, cut(5, 50, 64)), (2, cut(5, 50, 64)), (3, "ONE, two!"), (4, ""), (None, None), (7, cut(30, 500, 530)), (8, cut(40, 0, 13)), (9, "never seen before " * 6), (11, cut(26, 0, 20)), (12, "a b c")]
    file = str(tmp_path / "b.parquet")
    spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, w string").write.parquet(file)
    bench = spark.read.parquet(file)
    docs = tricky.filter("doc_id is null or doc_id <> 32")
    got = decontam.match(docs, bench).collect()
    want = hits([(r.doc_id, r.text) for r in docs.collect()], [(i, t) for i, t in items if i is not None])
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(n for (_, size, hit, _), n in want.items() if not (hit > 0 and 20 * hit >= size))
    close = decontam.proximity(docs, bench, slack=2)
    assert {r.doc_id for r in close.collect()} >= {r.doc_id for r in got if r.n_hit}


def test_decontamination_of_empty_tables(spark, empty, tricky):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.match(empty, none).count() == 0
    assert {r.n_hit for r in decontam.match(tricky, none).collect()} == {0}
