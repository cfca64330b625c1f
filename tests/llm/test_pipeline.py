"""The pipeline's stages against a plain run of what each should do, and on odd input."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from planeweave.llm import quality, queries, secrets
from tests.llm.test_operators import ODD, plain_similar

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before, at = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        at[name] = after
        if name != names[-1]:
            assert after.columns == docs.columns
            assert not set(r.doc_id for r in after.select("doc_id").collect()) - set(r.doc_id for r in before.select("doc_id").collect())
        before = after
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in at[names[0]].collect()} == kept
    rows = sorted((r.doc_id, r.text) for r in at[names[0]].collect())
    # five words and a similarity of 0.8, by comparing all pairs
    roots = set(plain_similar(*zip(*rows, strict=True)))
    assert {r.doc_id for r in at[names[1]].collect()} == roots
    assert {r.doc_id for r in at[names[2]].collect()} == roots
    assert not any(secrets.base_spans(r.text) for r in at[names[2]].collect())
    domain = {r.id: r.domain for r in queries.domains_of(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    left = {r.doc_id for r in at[names[3]].collect()}
    clean, toxic = ([i for i in roots if domain.get(i) == d] for d in ("clean", "toxic"))
    assert sum(i in left for i in clean) >= 0.95 * len(clean) and sum(i in left for i in toxic) <= 0.1 * len(toxic)
    packed = at[names[4]].collect()
    assert {r.doc_id for r in packed} == left
    # the cuts follow the partitions, which files may change; what is packed does not
    assert {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.doc_tokens) for r in packed}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, long and repeated texts, and further columns with names that the stages use."""
    more = "_counts _key _set _bucket _rate key base_failed distance kept n low component_id id row turns bears".split()
    schema = ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars', 'n') else 'string'}" for c in ("doc_id", "text", "lang", "source", "n_chars", *more))
    rows = [(r[0], r[1], r[2], r[3], r[4], *([None] * (len(more) - 1)), "x") for r in ODD]
    rows += [(50 + i // 2, " ".join(f"word{(i // 2) * 40 + k}, and" for k in range(30)) + " secret = abcdefghijklmnop", None if i % 4 > 1 else "en", "s", 9, *[None] * len(more)) for i in range(12)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows(spark, odd, k):
    name, stage = corpus_pipeline.STAGES[k]
    found = stage(spark, odd, "/root/testdata/sf0.001")
    rows = found.collect()
    ids = {r.doc_id for r in rows}
    if k < 4:
        assert found.columns == odd.columns
    if name == "quality rules":
        assert ids <= set(range(50, 56)) and all(sum(r.doc_id == i for r in rows) == 2 for i in ids)
    elif name == "near dedup":
        # one of the blank texts, of the repeated rows and ids; the row without an id stays
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(["1", "4", "5", "6", "7", "None", *map(str, range(50, 56))])
    elif name == "secret scan":
        assert len(rows) == odd.count() and not any(secrets.base_spans(r.text or "") for r in rows)
        assert [r.text for r in rows if r.doc_id == 1] == [None] and [r.text for r in rows if r.doc_id == 2] == [""]
    elif name == "mixing":
        assert len(rows) <= odd.count()
    else:
        assert ids == {r.doc_id for r in odd.collect()} and [r.doc_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert stage(spark, odd.where(F.lit(False)), "/root/testdata/sf0.001").collect() == []
