"""Stages keep rows and columns whatever the extra columns are called."""

import pytest

from scatterlake.llm import decontaminate, forest, paragraphs, quality, suffix

NAMES = ["span_doc_id", "removed_spans", "gone_id", "again_id", "leaked_id", "cut_doc_id", "cut_lines", "node", "hash", "class_id", "spans", "n", "copy", "h", "c", "p", "items", "words", "score", "predicted", "rep", "size", "y", "unit"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash"))
    long = " ".join(f"word{k}" for k in range(60))
    texts = ["a few good words here", long, long, "x " + long, None, ""]
    spark.createDataFrame([(k, t, *[str(k)] * len(NAMES)) for k, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like that is in any text at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", [quality.keep_good, forest.keep_one, suffix.cut_repeats, decontaminate.drop_leaked, lambda s, d, p: paragraphs.without_repeats(d)])
def test_extra_columns_stay(spark, tables, stage):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = stage(spark, docs, tables)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == str(r.doc_id) for r in rows for n in NAMES)
