"""The pipeline's stages against what they promise."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small, tmp_path):
    from spanloom.llm import personal_data

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert 0 < len(kept["near_duplicates"]) < len(kept["rules"]) < 200
    assert kept["repeated_passages"].keys() == kept["near_duplicates"].keys() == kept["private_data"].keys()
    assert all(r.n_chars == len(r.text) for r in kept["private_data"].values())
    assert not any(k == 0 for r in kept["private_data"].values() for _, k, _ in personal_data.patterns(r.text))
    seen = set()
    for k in sorted(kept["repeated_passages"]):
        text = kept["repeated_passages"][k].text
        assert len(text) <= len(kept["near_duplicates"][k].text)
        seen.add(k)


def test_run(spark, small):
    rows = pipeline.run(spark, small).collect()
    assert rows and all(0 < r.length <= 2048 for r in rows)


def test_empty(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0
