import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, rid string, score double, node string, digest string"
WORDS = [a + b for a in ("al", "be", "co", "du", "er", "fi") for b in ("mo", "ne", "pi", "ra", "su", "ta", "vu")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def tricky_rows() -> list[tuple]:
    """Nulls, empty, blank and very long texts, copies, near copies, repeated rows and ids, ties, odd characters."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "other", 1)
    texts = [
        (5, base), (3, base), (9, "  " + base.replace(" ", "\n")), (7, near), (11, base.upper()), (12, base + " and a tail of its own " + prose(2, 90)),
        (20, None), (21, ""), (22, " \t\n\x0b\x0c\r"), (23, "one two"), (24, "One  two"), (25, "one"), (26, "é " * 40 + prose(3, 30)), (27, "日本語 текст 🙂 İ ﬁ"),
        (30, prose(4, 110_000)), (31, prose(5, 30) + " " + prose(4, 110_000)[:4000]), (32, "x" * 700_000 + " end"), (33, "a" * 300), (34, "b" + "a" * 120),
        (40, prose(6, 60)), (40, prose(6, 60)), (41, prose(6, 60)), (None, prose(6, 60)), (None, None), (50, "mail a.b@c.example.org or +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111"),
    ]
    return [(d, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if i % 5 == 0 else 1, i, "r", 0.5, "n", None) for i, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def tricky(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tricky") / "documents.parquet")
    spark.createDataFrame(tricky_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
