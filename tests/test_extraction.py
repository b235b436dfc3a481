"""Extraction from page lists against the ways by cells, and what it shuffles and writes."""

import random

import pytest
from pyspark.sql import functions as F

from boxlake import fixtures as X
from boxlake.operators import dedup, fusion, spatial
from boxlake.plans import pipelines
from boxlake.queries import QUERIES
from boxlake.sources import documents
from boxlake.streaming import ingest
from helpers import detections, moved, random_boxes, texts

WORDS = ["Motor 1", "motor1", "M1", " ", "Valve", "valve 12", "_", None]


def side(spark, seed, n):
    rnd = random.Random(seed)
    rows = random_boxes(n, seed=seed, page=400, sizes=(5, 60))
    page = lambda rows, number: texts(spark, [(i, rnd.choice(WORDS), b) for i, _, b in rows], page=number)
    lost = page(rows[:3], 1).withColumn("page", F.lit(None).cast("int"))
    return page(rows[:40], 1).unionByName(page(rows, 2)).unionByName(page(rows[:9], 3)).unionByName(lost)


def inputs(spark):
    boxes = detections(spark, random_boxes(40, seed=3, page=400), cls="Tag-ID")
    for page, cls in ((2, "resistor"), (2, "Tag-ID"), (4, "resistor")):
        rows = [(i + 100 * (cls == "Tag-ID"), c, b) for i, c, b in random_boxes(30, seed=page, page=300, sizes=(10, 40))]
        boxes = boxes.unionByName(detections(spark, rows, page=page, cls=cls))
    gap = F.col("det_idx") % 13 == 5
    boxes = boxes.withColumn("x1", F.when(~gap, F.col("x1"))).withColumn("class_name", F.when(F.col("det_idx") != 7, F.col("class_name")))
    known = F.when(F.col("text_idx") % 3 == 0, F.col("text_idx") % 50)
    ocr = side(spark, 2, 150).withColumn("source", F.lit("ocr")).withColumn("sym_idx", known).withColumn("confidence", F.lit(0.5))
    return boxes, side(spark, 1, 150).drop("confidence", "source"), ocr.withColumn("x1", F.when(F.col("text_idx") != 11, F.col("x1")))


def step_by_step(spark, boxes, spans, ocr, columns):
    """The steps one after the other, each by its own operator."""
    kept = dedup.suppress(dedup.dedup_tags(boxes, 0.7), 0.5)
    found = spatial.spans_near_boxes(spans, kept).withColumn("sym_idx", F.lit(None).cast("long"))
    found = fusion.fuse(found, ocr) if ocr is not None else found
    return fusion.tag(spatial.with_symbol(spatial.nearest_symbol(found, kept, 40.0), kept, columns))


@pytest.mark.parametrize("with_ocr, limits", [(True, (1000, 60)), (False, (1000,))])
def test_extraction_of_pages_and_cells(spark, with_ocr, limits):
    boxes, spans, ocr = inputs(spark)
    ocr = ocr if with_ocr else None
    columns = ("class_name", "confidence", "x1", "y2")
    want = step_by_step(spark, boxes, spans, ocr, columns)
    names = sorted(want.columns)
    rows = lambda df: sorted(map(repr, df.select(*names).collect()))
    want = rows(want)
    assert len(want) > (150 if with_ocr else 60)
    for limit in limits:
        out = pipelines.extract_text(boxes, spans, ocr, radius=40.0, symbol_columns=columns, page_rows=limit).texts
        assert sorted(out.columns) == names and rows(out) == want


@pytest.mark.parametrize("limit", [512, 20, 1])
def test_tags_and_classes_folded_at_once(spark, limit):
    boxes = inputs(spark)[0]
    want = dedup.suppress(dedup.dedup_tags(boxes, 0.3), 0.5)
    assert sorted(map(repr, dedup.cleaned(boxes, 0.3, 0.5, fold_limit=limit).collect())) == sorted(map(repr, want.collect()))
    tags = dedup.dedup_tags(boxes, 0.3)
    assert sorted(map(repr, dedup.cleaned(boxes, 0.3, None, fold_limit=limit).collect())) == sorted(map(repr, tags.collect()))


BYTES = {"extracted_texts": 600, "calibrated_extraction": 700, "text_documents": 380}


@pytest.mark.parametrize("name", BYTES)
def test_extraction_shuffles_rows_once(spark, sf_dir, name):
    """Bytes shuffled and written for each line item, without broadcasts (before: 1,213, 1,258 and 497)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert moved(spark, lambda: QUERIES[name](spark, sf_dir)) < BYTES[name] * X.texts(spark, sf_dir).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_text_documents_listed_and_by_rows(spark, sf_dir):
    det = X.detections(spark, sf_dir)
    linked = spatial.with_symbol(X.ocr_texts(spark, sf_dir), det, ("class_name", "confidence", "x1", "y1", "x2", "y2", "tile", "row", "col"))
    tagged = fusion.tag(linked.withColumn("doc", F.col("doc") % 7)).filter("doc != 3 or page = 1").cache()
    every = spark.range(9).withColumnRenamed("id", "doc")  # two without texts
    rest = fusion.extraction_statistics(tagged, documents=every), fusion.pattern_counts(tagged)
    for record_rows in (10_000, 700, 100):
        want = sorted(map(tuple, documents.text_documents(fusion.by_relevance(tagged), *rest, record_rows).collect()))
        assert sorted(map(tuple, documents.text_documents(tagged, *rest, record_rows).collect())) == want
        assert len(want) >= 9


def test_a_batch_shuffles_no_records(spark, sf_dir):
    """Bytes shuffled and written for each line item (before: 383)."""
    used = moved(spark, lambda: QUERIES["streamed_reload"](spark, sf_dir))
    assert used < 340 * X.texts(spark, sf_dir).count()


def test_single_and_repeated_records_of_a_batch(spark, tmp_path):
    """Records that are alone, repeated in a file, and without a name."""
    page = lambda n: '"pages": [{"page": 1, "detections": [' + ", ".join(f'{{"class_id": {i}}}' for i in range(n)) + "]}]"
    lines = ['{"original_pdf": "a.pdf", %s}' % page(1), '{"original_pdf": "b.pdf", %s}' % page(2), '{"original_pdf": "b.pdf", %s}' % page(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join([*lines, "{%s}" % page(4), "{%s}" % page(5)]))
    table = str(tmp_path / "t")
    ingest.ingest_documents(ingest.document_stream(spark, str(tmp_path / "in")), table, str(tmp_path / "p")).awaitTermination()
    counts = spark.read.parquet(table).groupBy("doc").count().collect()
    assert sorted((r.doc or "", r["count"]) for r in counts) == [("", 4), ("a", 1), ("b", 2)]


def test_odd_values_of_documents(spark):
    odd = [
        '{"pages": [{"page": "x", "page_num": "2", "detections": [{"class_id": "3", "class_name": 1.50, "confidence": "0.5", "bbox_global": [1, "2", 3, 4]}, 7, null]}]}',
        '{"pages": [5, {"detections": {"a": 1}}, {"page": null, "original_width": 1e2, "detections": [{"bbox_global": {"x1": 1, "y1": 2, "x2": 3}}]}]}',
        '{"pages": [{"detections": [{"bbox_global": null, "global_bbox": [1, 2, 3, 4]}, {"global_bbox": [1, 2, 3, 4, null]}]}]}',
        '{"pages": [{"detections": [{"bbox_snippet": {"x1": 1, "y1": 2, "x2": 3, "y2": 4.5}, "snippet_position": [1, 2], "global_bbox": [1, 2, 3, "z"]}]}]}',
        '{"pages": [{"detections": [{"snippet_position": {"row": 2, "col": "1"}, "snippet_source": {"a": [1]}, "class_id": 1.9}]}]}',
        '{"pages": {"a": 1}}', "[1]", "nothing", None,
    ]
    docs = spark.createDataFrame([(str(i), v) for i, v in enumerate(odd)], "doc string, value string")
    names = ["doc", "page", "page_w", "det_idx", "class_id", "class_name", "confidence", "x1", "y2", "tx1", "ty2", "tile", "row", "col"]
    got = sorted(documents.parse_detections(docs).select(*names).collect(), key=lambda r: (r.doc, r.det_idx))

    def bare(doc, page, page_w, det_idx):
        return (doc, page, page_w, det_idx, 0, "unknown", 0.0, *[None] * 7)

    assert [tuple(r) for r in got] == [
        ("0", 2, None, 0, 3, "1.5", 0.5, 1.0, 4.0, *[None] * 5), bare("0", 2, None, 1), bare("0", 2, None, 2),
        bare("1", 1, 100, 0), bare("2", 1, None, 0), bare("2", 1, None, 1),
        ("3", 1, None, 0, 0, "unknown", 0.0, None, None, 1.0, 4.5, None, None, None),
        ("4", 1, None, 0, 1, "unknown", 0.0, *[None] * 4, '{"a":[1]}', 2, 1),
    ]
