"""The pipeline's stages on given and awkward documents."""

import corpus_pipeline
from pulse.llm.common import stored
from llm.tests_llm_rows import awkward_rows


def test_stages_keep_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stored(stage(spark, docs, sf), "stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.dtypes == docs.dtypes
        sizes.append(found.count())
        assert found.count() == found.select("doc_id").distinct().count()
        docs = found
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] // 2


def test_awkward_documents(spark):
    sf = "/root/testdata/sf0.001"
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (awkward_rows(), []):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, sf), "stage")
        ids = {r.doc_id for r in docs.collect()}
        assert not rows or (1 in ids and not ids & {3, 4, 6, 9})


def test_repeated_rows_stay_once(spark):
    text = "a passage of some words that is long enough to be told from any other"
    rows = [(1, text, "en", "b", 3)] * 3 + [(1, text, "en", "a", 3), (2, "other words altogether in this one", "en", "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(tuple(r) for r in found) == [rows[3], rows[4]]
    assert [f.name for f in corpus_pipeline.near_dedup(spark, docs, "").schema] == docs.columns
