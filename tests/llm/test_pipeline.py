"""The pipeline on small tables: its stages, and every query's columns."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from keystrata.llm import quality, setjoin
from tests.llm.test_texts import SCHEMA, WORD, brute_components, brute_removed, brute_targets, some_docs


def brute_cut(rows):
    """What is left of each text without repeated passages of more than fifty words."""
    raw = [(t or "").encode() for _, t in rows]
    for (i, _), t, short in zip(rows, raw, brute_removed(raw, 200)):
        cuts = [m.span() for m in re.finditer(b"\1+", short) if len(t[slice(*m.span())].split()) > 50]
        yield i, bytes(c for k, c in enumerate(t) if not any(a <= k < b for a, b in cuts)).decode("utf-8", "ignore")


def test_stages_in_order(spark):
    rows = some_docs(160, 12)
    docs = spark.createDataFrame(rows, SCHEMA)
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "source weights", "piece ids"]
    kept = corpus_pipeline.quality_rules(spark, docs, "").cache()
    assert kept.columns == names
    verdicts = {r["doc_id"]: r["kept"] for r in quality.with_verdicts(spark, docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in verdicts.items() if k}
    single = corpus_pipeline.near_duplicates(spark, kept, "").cache()
    want = brute_components([tuple(r) for r in kept.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    cut = corpus_pipeline.repeated_passages(spark, single, "").cache()
    assert cut.columns == names
    assert sorted((r["doc_id"], r["text"]) for r in cut.collect()) == sorted(brute_cut([(r["doc_id"], r["text"]) for r in single.collect()]))
    mixed = corpus_pipeline.source_weights(spark, cut, "").cache()
    assert mixed.columns == names
    words, sizes, whole = Counter(), Counter(), {}
    for r in cut.collect():
        whole[r["doc_id"]] = r["text"]
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 3 and all(r["text"] == whole[r["doc_id"]] for r in mixed.collect())
    for r in mixed.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert dict(words) == pytest.approx(brute_targets(dict(sizes)), rel=0.35)  # some thirty documents a source
    out = corpus_pipeline.piece_ids(spark, mixed, "")
    assert out.where("not exact").count() == 0 and out.count() == mixed.count()


def test_run(spark, tmp_path):
    spark.createDataFrame(some_docs(40, 13), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "lang", "source", "n_pieces", "exact", "ids"]
    assert setjoin.one_of_each(spark, spark.createDataFrame([], SCHEMA)).count() == 0
