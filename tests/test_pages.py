"""Tiles, regions of interest, relative boxes, calibration, overlays."""

import pytest
from pyspark.sql import functions as F

from boxlake.functions import geometry as G
from boxlake.operators import calibrate, overlay, relative, scoring, tiles
from boxlake.queries import QUERIES
from helpers import detections


def pages(spark, *sizes):
    return spark.createDataFrame([("d", i + 1, w, h) for i, (w, h) in enumerate(sizes)], "doc string, page int, page_w int, page_h int")


def test_golden_grid(spark):
    grid = tiles.tile_grid(pages(spark, (3000, 2400)))
    rows = grid.collect()
    assert {r.x1 for r in rows} == {0, 1000, 1500} and {r.y1 for r in rows} == {0, 700, 1200}
    assert len(rows) == 9 and "d_p1_r0_c1.png" in {r.tile for r in rows}


@pytest.mark.parametrize("size,overlap", [((1500, 1200), 500), ((800, 600), 0)])
def test_grid_covers_every_pixel(spark, size, overlap):
    for r in [(100, 80), (1500, 1200), (1501, 1199), (4321, 3777)]:
        rows = tiles.tile_grid(pages(spark, r), size, overlap).collect()
        for lo, hi, full in (("x1", "x2", r[0]), ("y1", "y2", r[1])):
            spans = sorted({(t[lo], t[hi]) for t in rows})
            assert spans[0][0] == 0 and spans[-1][1] == full
            assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))


def test_tile_to_page_drops_malformed(spark):
    grid = tiles.tile_grid(pages(spark, (3000, 2400)))
    found = spark.createDataFrame(
        [("d_p1_r0_c0.png", 0, 1, "PLC", 0.85, 100.0, 150.0, 200.0, 250.0), ("d_p1_r0_c1.png", 0, 1, "PLC", 0.85, 100.0, 150.0, 200.0, 250.0),
         ("d_p1_r0_c1.png", 1, 1, "PLC", 0.85, None, 150.0, 200.0, 250.0), ("gone.png", 0, 1, "PLC", 0.8, 0.0, 0.0, 1.0, 1.0)],
        "tile string, det_idx bigint, class_id int, class_name string, confidence double, bx1 double, by1 double, bx2 double, by2 double",
    )
    rows = tiles.to_global(found, grid).orderBy("det_idx").collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in rows] == [(100, 150, 200, 250), (1100, 150, 1200, 250)]


def test_geometry_of_the_sample_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 100.0, 100.0, 50.0, 50.0, 150.0, 150.0)], "x1 double, y1 double, x2 double, y2 double, bx1 double, by1 double, bx2 double, by2 double")
    a, b = G.box(), G.box("b")
    r = df.select(G.area(a), G.center_x(a), G.iou(a, b), G.overlap_ratio(a, b)).collect()[0]
    assert tuple(r) == (10000.0, 50.0, 2500 / 17500, 0.25)


def test_failed_batches_become_error_rows(spark):
    df = spark.createDataFrame([("a.png", "/a"), ("b.png", "/b")], "tile string, image_path string").coalesce(1)

    def broken(batch):
        raise RuntimeError("no model")

    def fine(batch):
        return [[{"class_id": 0, "class_name": "x", "confidence": c, "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0} for c in (0.1, 0.9)]] * len(batch)

    rows = scoring.score_tiles(df, broken).collect()
    assert [r.error for r in rows] == ["RuntimeError: no model"] * 2
    assert scoring.tile_detections(scoring.score_tiles(df, fine)).count() == 2


def linked(spark, rows):
    return spark.createDataFrame(
        [("d", 1, i, *map(float, b), 0 if s else None, *(map(float, s) if s else [None] * 4), row, 0 if row is not None else None) for i, (b, s, row) in enumerate(rows)],
        "doc string, page int, text_idx bigint, x1 double, y1 double, x2 double, y2 double, sym_idx bigint, sym_x1 double, sym_y1 double, sym_x2 double, sym_y2 double, row int, col int",
    )


def test_relative_round_trip(spark):
    df = linked(spark, [((10, 20, 30, 40), (5, 5, 25, 45), 0), ((1, 2, 3, 4), None, None), ((0, 0, 1, 1), (2, 2, 2, 2), 0)])
    rel = relative.to_relative(df)
    r = rel.orderBy("text_idx").collect()
    assert (r[0].x1, r[0].y2, r[0].x1_percent, r[0].y2_percent) == (5, 35, 25, 87.5)
    assert r[1].coordinate_system == "absolute" and r[2].x1_percent == 0
    back = relative.to_absolute(rel).select(df.columns)
    assert back.exceptAll(df).count() == 0


@pytest.mark.parametrize("hot", [1000, 3])
def test_offsets_and_median(spark, hot):
    df = linked(spark, [((x, x, x + 1, x + 1), (0, 0, 9, 9), x % 2) for x in (3000, 1000, 2000, 5000, 2500, 1500)])
    out, stats = calibrate.calibrate(df, hot=hot)
    s = stats.collect()[0]
    assert (s.sample_count, s.mean_x, s.median_x, s.min_x, s.max_x) == (6, 2500, 2250, 1000, 5000)
    assert s.correction_needed and s.correction == "tile"
    plain, stats = calibrate.calibrate(df.withColumn("row", F.lit(None).cast("int")), hot=hot)
    assert stats.collect()[0].correction == "offset"
    assert plain.agg(F.sum("x1")).collect()[0][0] == 0


def test_rotation_and_bands(spark):
    df = detections(spark, [(0, 0.95, (10, 20, 30, 60)), (1, 0.85, (0, 0, 1, 1)), (2, 0.845, (0, 0, 1, 1))])
    df = df.withColumns({"image_w": F.lit(200), "image_h": F.lit(100), "out_w": F.lit(100.0), "out_h": F.lit(200.0), "rotation": F.lit(90)})
    r = overlay.project_boxes(df, "rotate").filter("det_idx = 0").collect()[0]
    assert (r.x1, r.y1, r.x2, r.y2) == (20, 170, 60, 190)
    drawn = overlay.detection_primitives(df, 0.0).orderBy("idx").collect()
    assert [d.band for d in drawn] == ["high", "medium", "normal"] and drawn[0].label == "A 95%"


def test_tile_lists_are_not_broadcast(spark, sf_dir):
    """They are made from few pages, and Spark takes them for as small as these."""
    for name in ("tiles_to_page_numbered", "tile_completeness"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [tile" in plan and "BroadcastHashJoin [tile" not in plan
