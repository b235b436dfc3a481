"""What writing and reading documents does once, and records cut alike by both ways."""

from pyspark.sql import functions as F

from boxlake import fixtures as X
from boxlake.queries import QUERIES
from boxlake.sources import documents
from boxlake.streaming import ingest


def test_records_of_listed_pages_and_of_rows(spark, sf_dir):
    pages, found = X.pages(spark, sf_dir), X.detections(spark, sf_dir)
    made = [
        sorted(map(tuple, documents.detection_documents(pages, found, record_rows=97, page_rows=limit).collect()))
        for limit in (100_000, 150, 1)
    ]
    assert made[0] == made[1] == made[2] and len(made[0]) > 50


def test_converting_reads_its_input_once(spark, sf_dir):
    docs = documents.detection_documents(X.pages(spark, sf_dir), X.detections(spark, sf_dir)).cache()
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(value):
        seen.add(1)
        return value

    out = documents.convert_documents(docs.withColumn("value", read("value")))
    assert out.count() == docs.count()
    assert documents.parse_pages(out).count() == documents.parse_pages(docs).count()
    assert seen.value == docs.count()


def test_texts_are_tagged_once(spark, sf_dir):
    plan = QUERIES["text_documents"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()


def test_a_batch_has_files_for_every_core(spark, sf_dir):
    docs = documents.detection_documents(X.pages(spark, sf_dir), X.detections(spark, sf_dir))
    rows = ingest.replay(spark, docs.repartition(10))
    assert rows.select("batch_id").distinct().count() == 1
    assert rows.count() == X.detections(spark, sf_dir).count()
