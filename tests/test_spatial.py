import random

import pytest
from pyspark.sql import functions as F

from boxlake import session
from boxlake.operators import clusters, fusion, spatial
from helpers import detections, distance, random_boxes, texts


def closest(text, symbols, radius, inclusive=False):
    found = min(((distance(text, b), i) for i, _, b in symbols), default=None)
    if found is None:
        return None
    d, i = found
    return i if d < radius or (inclusive and d <= radius) else None


@pytest.mark.parametrize("limit", [1000, 3])
def test_nearest_symbol_by_brute_force(spark, limit):
    """With a small cell limit crowded cells are refined."""
    symbols = random_boxes(150, seed=1, page=500, sizes=(2, 30))
    spots = [(i, "t", b) for i, _, b in random_boxes(120, seed=2, page=700, sizes=(2, 30))]
    out = spatial.nearest_symbol(texts(spark, spots), detections(spark, symbols), 100.0, cell_limit=limit)
    got = {r.text_idx: r.sym_idx for r in out.collect()}
    assert got == {i: closest(b, symbols, 100.0) for i, _, b in spots}


def test_nearest_symbol_of_a_tight_crowd(spark):
    """All symbols lie within one pixel, far from the texts."""
    rnd = random.Random(3)
    symbols = []
    for i in range(80):
        x, y = 1000 + rnd.random(), 1000 + rnd.random()
        symbols.append((i, 0.5, (x, y, x, y)))
    spots = [(i, "t", (900 + i, 950 + 3 * i, 902 + i, 952 + 3 * i)) for i in range(30)]
    out = spatial.nearest_symbol(texts(spark, spots), detections(spark, symbols), 300.0, cell_limit=10)
    assert {r.text_idx: r.sym_idx for r in out.collect()} == {i: closest(b, symbols, 300.0) for i, _, b in spots}


def test_nearest_threshold_and_ties(spark):
    symbols = detections(spark, [(5, 0.5, (0, 0, 2, 2)), (3, 0.5, (200, 0, 202, 2)), (7, 0.5, (900, 0, 902, 2))])
    spots = texts(spark, [(0, "mid", (100, 0, 102, 2)), (1, "far", (1200, 0, 1202, 2))])
    got = {r.text_idx: r.sym_idx for r in spatial.nearest_symbol(spots, symbols, 300.0).collect()}
    assert got == {0: 3, 1: None}  # equally far: the first in the list; 300 is out
    got = {r.text_idx: r.sym_idx for r in spatial.nearest_symbol(spots, symbols, 300.0, inclusive=True).collect()}
    assert got == {0: 3, 1: 7}


def test_nearest_in_document_ignores_pages(spark):
    symbols = detections(spark, [(0, 0.5, (0, 0, 2, 2))], page=2)
    spots = texts(spark, [(0, "t", (10, 0, 12, 2))], page=1)
    assert spatial.nearest_symbol(spots, symbols, 50.0).collect()[0].sym_idx is None
    row = spatial.nearest_symbol(spots, symbols, 50.0, by_page=False).collect()[0]
    assert (row.sym_page, row.sym_idx) == (2, 0)
    wide = spatial.with_symbol(spatial.nearest_symbol(spots, symbols, 50.0, by_page=False), symbols)
    assert wide.collect()[0].sym_class_name == "A"


def test_existing_symbol_is_kept(spark):
    symbols = detections(spark, [(0, 0.5, (0, 0, 2, 2)), (1, 0.5, (500, 0, 502, 2))])
    spots = texts(spark, [(0, "t", (0, 0, 2, 2))]).withColumn("sym_idx", F.lit(1).cast("long"))
    assert spatial.nearest_symbol(spots, symbols).collect()[0].sym_idx == 1
    assert spatial.nearest_symbol(spots, symbols, keep_existing=False).collect()[0].sym_idx == 0


def test_spans_near_boxes_by_brute_force(spark):
    boxes = random_boxes(40, seed=6, page=3000, sizes=(5, 700))
    spots = [(i, "t", b) for i, _, b in random_boxes(200, seed=7, page=4000)]

    def near(t):
        cx, cy = (t[0] + t[2]) / 2, (t[1] + t[3]) / 2
        for _, _, (x1, y1, x2, y2) in boxes:
            w, h = x2 - x1, y2 - y1
            if max(0, x1 - w) <= cx <= x2 + w and max(0, y1 - h) <= cy <= y2 + h:
                return True
        return False

    out = spatial.spans_near_boxes(texts(spark, spots), detections(spark, boxes))
    assert {r.text_idx for r in out.collect()} == {i for i, _, b in spots if near(b)}


def test_huge_box_and_other_page(spark):
    boxes = detections(spark, [(0, 0.9, (0, 0, 50000, 50000))])
    same, other = texts(spark, [(0, "a", (40000, 40000, 40010, 40010))]), texts(spark, [(1, "b", (1, 1, 2, 2))], page=2)
    assert {r.text_idx for r in spatial.spans_near_boxes(same.unionByName(other), boxes).collect()} == {0}


def test_span_scale(spark):
    boxes = detections(spark, [(0, 0.9, (100, 100, 120, 120))])
    spans = texts(spark, [(0, "a", (52, 52, 56, 56))]).withColumn("k", F.lit(2.0))
    assert spatial.spans_near_boxes(spans, boxes).count() == 0
    assert spatial.spans_near_boxes(spans, boxes, scale="k").count() == 1


def test_fusion_drops_repeats_only(spark):
    pdf = texts(spark, [(0, "Motor-1", (0, 0, 100, 20)), (1, "K7", (0, 100, 40, 120))])
    ocr = texts(
        spark,
        [
            (0, "motor1", (5, 0, 100, 20)),        # same text, same place
            (1, "the motor 1 x", (2, 2, 98, 18)),  # contains it
            (2, "pump", (0, 0, 100, 20)),          # other text
            (3, "motor1", (300, 0, 400, 20)),      # other place
            (4, "K7", (0, 100, 3000, 2000)),       # huge box around it
            (5, "--", (0, 0, 100, 20)),            # nothing to compare
        ],
        source="ocr",
    )
    out = fusion.fuse(pdf, ocr).filter("source = 'ocr'").collect()
    assert {r.text_idx - (1 << 62) for r in out} == {2, 3, 5}
    strict = fusion.fuse(pdf, ocr, strict_ratio=0.8).filter("source = 'ocr'").collect()
    assert {r.text_idx - (1 << 62) for r in strict} == {1, 2, 3, 5}


def components(rows, radius):
    label = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, _, a in rows:
            for j, _, b in rows:
                if distance(a, b) <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("seed,page,radius", [(1, 900, 60.0), (4, 60, 9.5)])
def test_clusters_by_brute_force(spark, seed, page, radius):
    rows = [(i, "t", b) for i, _, b in random_boxes(130, seed=seed, page=page, sizes=(2, 12))]
    out = clusters.clusters(texts(spark, rows), radius)
    assert {r.text_idx: r.cluster_id for r in out.collect()} == components(rows, radius)


def test_long_chain_is_one_cluster(spark):
    rows = [(i, "t", (i * 100, (i % 2) * 3, i * 100, (i % 2) * 3)) for i in range(120)]
    out = clusters.clusters(texts(spark, rows), 100.1)
    assert {r.cluster_id for r in out.collect()} == {0}
    apart = clusters.clusters(texts(spark, rows), 99.9)
    assert apart.select("cluster_id").distinct().count() == 120


def test_distance_equal_to_radius_links(spark):
    rows = [(0, "t", (0, 0, 0, 0)), (1, "t", (60, 80, 60, 80)), (2, "t", (60, 181, 60, 181))]
    got = {r.text_idx: r.cluster_id for r in clusters.clusters(texts(spark, rows), 100.0).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_connected_components_of_a_path(spark):
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(200)] + [("h", 5, 9)], "k string, a int, b int")
    out = {(r.k, r.node): r.root for r in clusters.connected_components(edges, ["k"]).collect()}
    assert {v for (k, _), v in out.items() if k == "g"} == {0} and out[("h", 9)] == 5


def test_area_type_and_counts(spark):
    symbols = detections(spark, [(0, 0.9, (0, 0, 10, 10))], cls="resistor").unionByName(
        detections(spark, [(1, 0.9, (60, 0, 70, 10))], cls="label")
    )
    rows = [(0, "a", (0, 0, 10, 10)), (1, "b", (5, 5, 15, 15)), (2, " ", (60, 0, 70, 10)), (3, "z", (900, 900, 910, 910))]
    areas, members = clusters.cluster_areas(texts(spark, rows), symbols)
    got = {r.cluster_id: r for r in areas.collect()}
    assert (got[0].area_type, got[0].text_count, got[0].symbol_count) == ("component", 2, 2)
    assert got[0].area_id == "area_component_000_000"
    assert (got[3].area_type, got[3].area_id) == ("text", "area_text_009_009")
    assert members.count() == 4


def test_large_written_tables_are_not_broadcast(spark):
    """A file below Spark's threshold may hold many times as much in rows."""
    def plan(n):
        a, b = (session.cut_sized(spark.range(n).selectExpr("id", f"hash(id) as {c}")) for c in "xy")
        return a.join(b, "id")._jdf.queryExecution().executedPlan().toString()

    assert "SortMergeJoin" in plan(300_000)
    assert "BroadcastHashJoin" in plan(10)
