"""Documents, areas, numbering and streaming, with hot groups forced by small limits."""

import json

from pyspark.sql import functions as F

from boxlake import fixtures, session
from boxlake.operators import areas, catalog, fusion, ranking, scoring
from boxlake.plans import pipelines
from boxlake.sources import documents, tables
from boxlake.streaming import ingest


def docs(spark, *values):
    return spark.createDataFrame([(f"d{i}", json.dumps(v)) for i, v in enumerate(values)], "doc string, value string")


BOXES = [
    {"class_name": "a", "confidence": 0.5, "bbox_global": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}},
    {"global_bbox": [1, "2", 3.5, 4]},
    {"bbox_global": [1, 2, 3]},
    {"bbox_global": {"x1": "x", "y1": 2, "x2": 3, "y2": 4}},
    {"bbox_global": None},
]


def test_both_spellings_and_bad_boxes(spark):
    df = documents.parse_detections(docs(spark, {"pages": [{"page_num": 3, "detections": BOXES}]}))
    rows = df.orderBy("det_idx").collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in rows] == [(1, 2, 3, 4), (1, 2, 3.5, 4)] + [(None,) * 4] * 3
    assert {r.page for r in rows} == {3} and rows[1].class_name == "unknown" and rows[1].confidence == 0.0


def test_unknown_keys_give_no_box(spark):
    odd = {"pages": [{"page_number": 2, "detections": [{"class": "x", "bbox": [1, 2, 3, 4]}]}]}
    r = documents.parse_detections(docs(spark, odd)).collect()[0]
    assert (r.page, r.x1) == (1, None)


def test_structure_report(spark):
    ok = {"pages": [{"detections": [{"global_bbox": [1, 2, 3, 4]}]}]}
    files = docs(spark, ok, {"pages": []}, {}, {"pages": [{}]}, {"pages": [{"detections": []}]}, {"pages": [{"detections": [{}]}]})
    bad = spark.createDataFrame([("d9", "{oops")], "doc string, value string")
    rows = documents.structure_report(files.unionByName(bad).withColumnRenamed("doc", "path")).orderBy("path").collect()
    assert [r.compatible for r in rows] == [True, False, False, False, True, False, False]


def flat(spark, n):
    return spark.createDataFrame(
        [("d", 1 + i % 2, 100, 80, i, 0, "a", 0.5, 1.0 * i, 2.0, 3.0, 4.0, 0.0, 0.0, 1.0, 1.0, "t", 0, 0) for i in range(n)],
        documents_schema(),
    )


def documents_schema():
    from boxlake.schemas import DETECTIONS

    return DETECTIONS


def test_long_documents_are_split_and_read_back(spark):
    df = flat(spark, 50)
    pages = spark.createDataFrame([("d", p, 100, 80) for p in (1, 2, 3)], "doc string, page int, page_w int, page_h int")
    parts = documents.detection_documents(pages, df)
    assert parts.count() == 1  # one record however long
    back = documents.parse_detections(parts).orderBy("page", "det_idx").collect()
    assert [(r.page, r.det_idx, r.x1) for r in back] == [(p, i, 2.0 * i + p - 1) for p in (1, 2) for i in range(25)]
    assert documents.parse_pages(parts).count() == 3


def test_numbering_of_a_hot_group(spark):
    df = spark.createDataFrame([("a", (i * 37) % 101) for i in range(101)] + [("b", 5)], "k string, v int")
    plain = ranking.numbered(df, ["k"], [F.col("v").desc()], "n")
    spread = ranking.numbered(df, ["k"], [F.col("v").desc()], "n", hot=10)
    assert plain.exceptAll(spread).count() == 0 and spread.count() == 102


def test_tag_rows_of_a_long_area(spark):
    rows = spark.createDataFrame(
        [("d", 1, "area_Tag-ID_000_000", "symbol", f"w{i}", 1.0, float(i % 5), float(i // 5), 1.0, 1.0, "ocr", i) for i in range(23)],
        "document string, page int, area_id string, area_type string, text_content string, confidence double, x double, y double, width double, height double, source string, text_idx bigint",
    )
    whole = areas.tag_rows(rows).collect()
    assert len(whole) == 1
    assert whole[0].tag_text == " ".join(f"w{i}" for i in range(23))
    assert whole[0].bbox_x2 == 5.0


def test_scratch_removes_intermediate_tables(spark):
    from pathlib import Path

    from boxlake import session

    folder = Path(session.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with session.scratch(spark):
        df = session.cut_lineage(spark.range(5))
        assert df.count() == 5 and len(set(folder.iterdir())) == len(before) + 1
    assert set(folder.iterdir()) == before


def test_document_names(spark):
    names = ["1150_detections.json", "1150_detections_converted.json", "x_converted.json", "y__detections.json", "z.json"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(catalog.document_name(F.col("n"))).collect()]
    assert got == ["1150", "1150", "x", "y", "z"]


def test_tables_and_listing(spark, tmp_path):
    df = flat(spark, 10)
    tables.write_table(df, str(tmp_path / "t"), buckets=4)
    assert tables.read_table(spark, str(tmp_path / "t"), ["d"], buckets=4).count() == 10
    names = {r.name.rsplit(".", 1)[-1] for r in tables.listing(spark, str(tmp_path / "t"), "*.parquet").collect()}
    assert names == {"parquet"}


def test_stream_skips_known_documents(spark, tmp_path):
    pages = spark.createDataFrame([("d", p, 100, 80) for p in (1, 2)], "doc string, page int, page_w int, page_h int")
    value = documents.detection_documents(pages, flat(spark, 6)).collect()[0].value
    folder, table, progress = tmp_path / "in", str(tmp_path / "table"), tmp_path / "p"
    folder.mkdir()
    (folder / "one.txt").write_text(value + "\n")

    def run(name, force=False):
        stream = ingest.document_stream(spark, str(folder))
        ingest.ingest_documents(stream, table, str(progress / name), force=force).awaitTermination()
        return spark.read.parquet(table)

    assert run("a").count() == 6
    (folder / "two.txt").write_text(value + "\n" + value.replace('"d.pdf"', '"e.pdf"') + "\n")
    assert run("a").groupBy("doc").count().collect()[0]["count"] == 6
    assert {r.doc for r in spark.read.parquet(table).select("doc").distinct().collect()} == {"d", "e"}
    assert ingest.latest_documents(spark.read.parquet(table)).count() == 12
    assert run("b").count() == 12  # a new checkpoint skips what the table holds
    again = run("c", force=True)
    assert again.count() == 24 and ingest.latest_documents(again).count() == 12


def test_tile_results_keep_the_last(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    schema = "tile string, detection_count bigint, error string"
    for n in (1, 2):
        rows = spark.createDataFrame([("a.png", n, None), (f"only{n}.png", 0, "x")], schema)
        rows.coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        ingest.ingest_tile_results(stream, table, str(tmp_path / "p")).awaitTermination()
    merged = ingest.merged_tile_results(spark.read.parquet(table))
    assert {r.tile: r.detection_count for r in merged.collect()} == {"a.png": 2, "only1.png": 0, "only2.png": 0}


def write_lines(folder, name, *values):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(v + "\n" for v in values))


def document(pdf, boxes):
    items = [{"class_name": "A", "confidence": 0.5, "bbox_global": {"x1": i, "y1": 0, "x2": i + 1, "y2": 1}} for i in range(boxes)]
    return json.dumps({"original_pdf": pdf, "pages": [{"page_num": 1, "detections": items}]})


def test_stream_keeps_documents_of_equal_name_apart(spark, tmp_path):
    write_lines(tmp_path / "in", "x.txt", document("a/p.pdf", 3), document("b/p.pdf", 5))
    stream = ingest.document_stream(spark, str(tmp_path / "in"))
    ingest.ingest_documents(stream, str(tmp_path / "t"), str(tmp_path / "p")).awaitTermination()
    got = ingest.current_documents(spark, str(tmp_path / "t")).groupBy("doc").count().collect()
    assert {(r.doc, r["count"]) for r in got} == {("a/p", 3), ("b/p", 5)}


def test_stream_reload_of_an_emptied_document(spark, tmp_path):
    table = str(tmp_path / "t")
    for name, value, force in (("one", document("d.pdf", 2), False), ("two", document("d.pdf", 0), True), ("three", document("d.pdf", 4), False)):
        write_lines(tmp_path / name, "x.txt", value)
        stream = ingest.document_stream(spark, str(tmp_path / name))
        ingest.ingest_documents(stream, table, str(tmp_path / f"p{name}"), force=force).awaitTermination()
        expected = {"one": 2, "two": 0, "three": 0}[name]  # the empty document counts as loaded
        assert ingest.current_documents(spark, table).count() == expected


def test_tile_results_of_one_batch_keep_the_last(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7)], "tile string, detection_count bigint").coalesce(1)
    for order in (None, "detection_count"):
        base = tmp_path / str(order)
        rows.write.parquet(str(base / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(base / "in"))
        ingest.ingest_tile_results(stream, str(base / "t"), str(base / "p"), order=order).awaitTermination()
        merged = ingest.merged_tile_results(spark.read.parquet(str(base / "t"))).collect()
        assert {r.tile: r.detection_count for r in merged} == {"a": 2, "b": 7}


def test_pages_without_known_key_number_on(spark):
    box = {"class_name": "A", "confidence": 0.5, "bbox_global": [0, 0, 1, 1]}
    value = json.dumps({"pages": [{"page_number": 3, "detections": [box, box]}, {"page_number": 4, "detections": [box]}, {"page": 2, "detections": [box]}]})
    df = spark.createDataFrame([("d", value), ("e", "not json")], "doc string, value string")
    got = documents.parse_detections(df).select("page", "det_idx").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_reader_reports_rows_that_fail(spark):
    def read(batch):
        if (batch["n"] == 3).any():
            raise ValueError("bad region")
        return [(["t"], [0.9], [[[0.0, 0.0]]])] * len(batch)

    out = scoring.read_regions(spark.range(10).withColumnRenamed("id", "n").coalesce(1), read).collect()
    assert {r.n: r.error for r in out if r.error} == {3: "ValueError: bad region"}
    assert sum(len(r.rec_texts) for r in out) == 9


def test_a_failed_batch_is_read_in_halves(spark, tmp_path):
    """One bad region of many costs a few calls, not one for each region."""
    calls = str(tmp_path / "calls")

    def read(batch):
        with open(calls, "a") as f:
            f.write(".")
        if (batch["n"] == 700).any():
            raise ValueError("bad")
        return [([str(n)], [1.0], [[[0.0, 0.0]]]) for n in batch["n"]]

    out = scoring.read_regions(spark.range(1000).withColumnRenamed("id", "n"), read).collect()
    assert {r.n: (r.rec_texts, r.error) for r in out} == {n: ([], "ValueError: bad") if n == 700 else ([str(n)], None) for n in range(1000)}
    assert len(open(calls).read()) < 100


def test_documents_without_texts_have_statistics(spark):
    tagged = spark.createDataFrame(
        [("d", "x", 1.0, 2.0, "ocr", None)], "doc string, text string, confidence double, relevance double, source string, sym_idx bigint"
    )
    read = spark.createDataFrame([("d",), ("e",)], "doc string")
    found = fusion.extraction_statistics(tagged, documents=read)
    assert {(r.doc, r.total_texts) for r in found.collect()} == {("d", 1), ("e", 0)}
    assert fusion.run_summary(found, read).first().processed_files == 2


def test_a_document_of_any_size_comes_in_bounded_records(spark):
    import json

    df = flat(spark, 50)
    pages = spark.createDataFrame([("d", p, 100, 80) for p in (1, 2, 3, 4)] + [("e", 1, 9, 9)], "doc string, page int, page_w int, page_h int")
    for spelling in ("bbox_global", "global_bbox"):
        records = documents.detection_documents(pages, df, spelling, record_rows=7).collect()
        sizes = [sum(len(p["detections"]) for p in json.loads(r.value)["pages"]) for r in records]
        assert max(sizes) <= 7 and sum(sizes) == 50
        assert {json.loads(r.value)["last_part"] for r in records if r.doc == "d"} == {7}
        again = spark.createDataFrame(records)
        back = documents.parse_detections(again).orderBy("page", "det_idx").collect()
        assert [(r.page, r.det_idx, r.x1) for r in back] == [(p, i, 2.0 * i + p - 1) for p in (1, 2) for i in range(25)]
        assert sorted((r.doc, r.page) for r in documents.parse_pages(again).collect()) == [("d", 1), ("d", 2), ("d", 3), ("d", 4), ("e", 1)]


def tag_area(spark, n, doc="d"):
    return spark.createDataFrame(
        [(doc, 1, "area_Tag-ID_000_000", "symbol", f"w{i}", 1.0, float(i % 5), float(i // 5), 1.0, 1.0, "ocr", i) for i in range(n)],
        "document string, page int, area_id string, area_type string, text_content string, confidence double, x double, y double, width double, height double, source string, text_idx bigint",
    )


def test_tag_rows_are_cut_by_position(spark):
    parts = areas.tag_rows(tag_area(spark, 23), part_texts=10).orderBy("bbox_y1").collect()
    assert [p.tag_text for p in parts] == [" ".join(f"w{i}" for i in range(lo, min(lo + 10, 23))) for lo in (0, 10, 20)]
    assert [(p.bbox_y1, p.bbox_y2) for p in parts] == [(0.0, 2.0), (2.0, 4.0), (4.0, 5.0)]


def lines_of(folder):
    return [line for f in sorted(folder.glob("part-*")) for line in f.read_text().splitlines()]


def test_tag_lists_are_written_and_read_back(spark, tmp_path):
    rows = areas.tag_rows(tag_area(spark, 4).unionByName(tag_area(spark, 3, "e")))
    documents.write_tag_csv(rows, str(tmp_path / "all"))
    back = spark.read.option("header", True).csv(str(tmp_path / "all"))
    assert back.columns[:2] == ["document", "TAG_TEXT"] and len(back.columns) == 10
    assert {(r.document, r.TAG_TEXT) for r in back.collect()} == {("d", "w0 w1 w2 w3"), ("e", "w0 w1 w2")}
    known = spark.createDataFrame([("d",), ("none",)], "document string")
    documents.write_tag_csv(rows, str(tmp_path / "by"), known, by_doc=True)
    head = "TAG_TEXT,BBOX_X1,BBOX_Y1,BBOX_X2,BBOX_Y2,BBOX_WIDTH,BBOX_HEIGHT,CONFIDENCE,PAGE"
    assert lines_of(tmp_path / "by" / "document=none") == [head]
    assert lines_of(tmp_path / "by" / "document=d") == [head, "w0 w1 w2 w3,0.0,0.0,4.0,1.0,4.0,1.0,0.950,1"]
    assert len(lines_of(tmp_path / "by" / "document=e")) == 2


def test_reports_are_written_and_read_back(spark, tmp_path):
    pages = spark.createDataFrame([("d", p, 100, 80) for p in (1, 2, 3)], "doc string, page int, page_w int, page_h int")
    report = documents.coordinate_report(pages, flat(spark, 5))
    documents.write_report(report, str(tmp_path / "all"))
    want = [r.line for r in report.orderBy("doc", "page", "ord").collect()]
    assert [r.line for r in spark.read.parquet(str(tmp_path / "all")).orderBy("doc", "page", "ord").collect()] == want
    documents.write_report(report, str(tmp_path / "by"), by_doc=True)
    assert lines_of(tmp_path / "by" / "doc=d") == "\n".join(want).split("\n")


def test_documents_are_read_from_files(spark, tmp_path):
    pages = spark.createDataFrame([("d", p, 100, 80) for p in (1, 2)], "doc string, page int, page_w int, page_h int")
    docs = documents.detection_documents(pages, flat(spark, 6))
    documents.write_documents(docs, str(tmp_path / "lines"))
    back = documents.parse_detections(documents.read_lines(spark, str(tmp_path / "lines")))
    assert {(r.doc, r.page, r.det_idx) for r in back.collect()} == {("d", p, i) for p in (1, 2) for i in range(3)}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "d_detections.json").write_text(docs.first().value)
    files = documents.files_with_documents(documents.read_files(spark, str(tmp_path / "files")))
    assert documents.parse_detections(files.select("doc", "value")).count() == 6 and files.first().doc == "d"


def test_later_load_wins_whatever_the_clock_says(spark, tmp_path, monkeypatch):
    import json
    import time

    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()

    def load(name, x, clock, force=True):
        value = {"original_pdf": "d.pdf", "pages": [{"page": 1, "detections": [{"global_bbox": [x, 0, 9, 9]}] * int(x)}]}
        (folder / f"{name}.txt").write_text(json.dumps(value) + "\n")
        monkeypatch.setattr(time, "time", lambda: clock)
        ingest.ingest_documents(ingest.document_stream(spark, str(folder)), table, str(tmp_path / name), force=force).awaitTermination()
        monkeypatch.undo()
        return sorted(r.x1 for r in ingest.current_documents(spark, table).collect())

    assert load("one", 3.0, 9e9) == [3.0] * 3
    (folder / "one.txt").unlink()
    assert load("two", 2.0, 5.0) == [2.0] * 2
    target = str(tmp_path / "compact")
    ingest.compact_documents(spark, table, target)
    assert sorted(r.x1 for r in ingest.current_documents(spark, target).collect()) == [2.0] * 2
    table = target
    (folder / "two.txt").unlink()
    assert load("three", 1.0, 1.0) == [1.0]


def test_each_region_is_read_once(spark, sf_dir, tmp_path):
    seen = str(tmp_path / "seen")

    def read(batch):
        with open(seen, "a") as f:
            f.write("." * len(batch))
        return [(["t"], [0.9], [[[0.0, 0.0], [1.0, 1.0]]])] * len(batch)

    det = fixtures.detections(spark, sf_dir)
    sizes = fixtures.pages(spark, sf_dir).selectExpr("doc", "page", "page_w * 2 as image_w", "page_h * 2 as image_h")
    out = pipelines.recognise(det, sizes, read)
    assert out.count() == len(out.collect()) == len(open(seen).read())


def test_ingest_leaves_only_its_table(spark, sf_dir, tmp_path, monkeypatch):
    """What a batch and a replay write on the way is gone when they end."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    det, pages = fixtures.detections(spark, sf_dir), fixtures.pages(spark, sf_dir)
    docs = documents.detection_documents(pages, det)
    assert ingest.replay(spark, docs, again=docs, force=True).count() == det.count()
    assert len(list(tmp_path.iterdir())) == 1
    base = next(tmp_path.iterdir())
    assert {p.name for p in base.iterdir()} == {"table", "progress-first", "progress-again"}


def test_extraction_leaves_only_its_results(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    found = pipelines.extract_text(fixtures.detections(spark, sf_dir), fixtures.spans(spark, sf_dir), fixtures.ocr_texts(spark, sf_dir))
    assert found.texts.count() > found.statistics.count() > 0 and found.detections.count() > 0
    assert len(list(tmp_path.iterdir())) == 2
