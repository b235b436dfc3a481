"""The pipeline, and the queries of the package."""

import corpus_pipeline

import __spark_entry__
from boxlake.llm import decontaminate, neardup
from tests.llm.helpers import documents


def test_stages_in_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.count())
        if name == "near_dedup":
            assert neardup.components(docs).filter("not kept").count() == 0
        if name == "decontamination":
            left = decontaminate.add_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert left.filter("size(items) > 0").count() == 0
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    assert {"doc_id", "taken", "target"} <= set(docs.columns)


def test_line_stage_removes_whatever_share_is_repeated(spark):
    line = "This boilerplate line is found everywhere."
    texts = ["\n".join([line] * 5), line + "\nAn own short line of this page.", line]
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, documents(spark, texts), "").collect()}
    assert out == {0: line, 1: "An own short line of this page.", 2: ""}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} >= set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
