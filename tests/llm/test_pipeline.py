"""The pipeline: stages keep the columns, and each decision agrees with a brute force of its stage."""

from pathlib import Path

import pytest

import corpus_pipeline
from pitspark.llm import packing, queries
from pitspark.llm.common import stored, table
from tests.llm.test_dedup import near_classes, norm
from tests.llm.test_rules import hits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.select("doc_id", "text").collect()
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns
        seen[name] = (before, {r.doc_id for r in docs.select("doc_id").collect()})
    before, kept = seen["quality"]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert len([r for r in before if labels.get(r.doc_id) == 1 and r.doc_id not in kept]) <= 2
    before, kept = seen["exact_dedup"]
    best = {}
    for r in before:
        best[norm(r.text)] = min(best.get(norm(r.text), (1, 0)), (-len(r.text), r.doc_id))
    assert kept == {d for _, d in best.values()}
    before, kept = seen["near_dedup"]
    assert kept == {d for d, _, c in near_classes(before) if d == c}
    before, kept = seen["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert kept == {d for (d, n, h, _) in hits([(r.doc_id, r.text) for r in before], items) if not (h > 0 and 20 * h >= n)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == kept


def test_odd_tables(spark, tricky, empty):
    """Every stage takes rows with nulls, clashing columns and no rows at all."""
    for docs in (tricky.filter("doc_id is null or doc_id not in (30, 32)"), empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, docs, SF))
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out
        packing.pack(docs, packing.tokenizer_file()).collect()


def test_names():
    assert sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0])) and len(queries.QUERIES) == 13
    assert set(queries.ORACLES) <= set(queries.QUERIES)
