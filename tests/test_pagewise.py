"""Pages settled whole against the ways by cells, brute force, and what they shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from boxlake import fixtures as X
from boxlake.operators import clusters, dedup, fusion, pagewise, spatial
from boxlake.queries import QUERIES
from helpers import detections, distance, moved, random_boxes, texts


def chains(rows, radius):
    """Smallest id of each chain of boxes whose centers lie within the radius."""
    label = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, _, a in rows:
            for j, _, b in rows:
                if label[j] < label[i] and distance(a, b) <= radius:
                    label[i], changed = label[j], True
    return label


def three_pages(spark):
    """A page of few texts, one of many, and one with copies in a row."""
    pages = [[(i, "t", b) for i, _, b in random_boxes(n, seed=n, page=400, sizes=(2, 20))] for n in (12, 90)]
    pages.append([(i, "t", (10 * (i // 3), 0, 10 * (i // 3) + 2, 2)) for i in range(60)])
    df = None
    for n, rows in enumerate(pages):
        page = texts(spark, rows, page=n + 1)
        df = page if df is None else df.unionByName(page)
    return pages, df


@pytest.mark.parametrize("page_rows", [1000, 50, 1])
def test_clusters_of_pages_and_cells(spark, page_rows):
    pages, df = three_pages(spark)
    got = {(r.page, r.text_idx): r.cluster_id for r in clusters.clusters(df, 30.0, page_rows=page_rows).collect()}
    assert got == {(n + 1, i): c for n, rows in enumerate(pages) for i, c in chains(rows, 30.0).items()}


@pytest.mark.parametrize("page_rows", [1000, 50, 1])
def test_areas_of_pages_and_cells(spark, page_rows, monkeypatch):
    pages, df = three_pages(spark)
    symbols = detections(spark, random_boxes(40, seed=3, page=400), page=2, cls="resistor")
    want = [tuple(r) for r in clusters.cluster_areas(df, symbols, 30.0)[0].orderBy("page", "cluster_id").collect()]
    monkeypatch.setattr(pagewise.large_groups, "__defaults__", (page_rows,))
    areas, members = clusters.cluster_areas(df, symbols, 30.0)
    assert [tuple(r) for r in areas.orderBy("page", "cluster_id").collect()] == want
    assert len(want) == sum(len(set(chains(rows, 30.0).values())) for rows in pages)
    assert members.filter("page = 2 and sym_class_name = 'resistor' and sym_idx is not null").count() > 0


def test_texts_without_place_or_symbols(spark):
    rows = texts(spark, [(0, "a", (0, 0, 2, 2)), (1, "b", (4, 0, 6, 2))]).withColumn("x1", F.when(F.col("text_idx") == 1, F.col("x1")))
    got = {r.text_idx: (r.sym_idx, r.sym_dist) for r in spatial.nearest_symbol(rows, detections(spark, [(7, 0.5, (4, 0, 6, 2))])).collect()}
    assert got == {0: (None, None), 1: (7, 0.0)}
    none = detections(spark, [(7, 0.5, (4, 0, 6, 2))], page=9)
    assert [r.sym_idx for r in spatial.nearest_symbol(rows, none).collect()] == [None, None]
    areas, _ = clusters.cluster_areas(rows, none)
    assert [(r.cluster_id, r.symbol_count, r.area_type) for r in areas.collect()] == [(1, 0, "text")]


@pytest.mark.parametrize("strict", [None, 0.8])
def test_fused_on_pages_and_in_cells(spark, strict):
    rnd = random.Random(5)
    words = ["Motor 1", "motor1", "M1", " ", "Valve", "valve 12", None]

    def side(seed):
        rows = random_boxes(120, seed=seed, page=300, sizes=(5, 60))
        return texts(spark, [(i, rnd.choice(words), b) for i, _, b in rows[:30]]).unionByName(
            texts(spark, [(i, rnd.choice(words), b) for i, _, b in rows], page=2)
        )

    pdf, ocr = side(1), side(2).withColumn("source", F.lit("ocr"))
    got = [
        sorted((r.page, r.text_idx) for r in fusion.fuse(pdf, ocr, strict_ratio=strict, page_rows=limit).collect())
        for limit in (1000, 60, 1)
    ]
    assert got[0] == got[1] == got[2] and 150 < len(got[0]) < 300


def test_overlaps_on_pages_and_in_cells(spark):
    df = detections(spark, random_boxes(30, seed=1, page=200)).unionByName(detections(spark, random_boxes(120, seed=2, page=300), page=2))
    df = df.unionByName(detections(spark, [(i, 0.5, (0, 0, 0, 5)) for i in range(3)], page=3))  # without area
    for threshold in (0.3, 1.0):
        counts = [sorted(map(tuple, dedup.overlap_summary(df, threshold, page_rows=limit).collect())) for limit in (1000, 60, 1)]
        assert counts[0] == counts[1] == counts[2] and len(counts[0]) == 3
        first = [sorted(map(tuple, dedup.overlap_sample(df, threshold, 7, page_rows=limit).collect())) for limit in (1000, 60, 1)]
        assert first[0] == first[1] == first[2]
    assert len(first[0]) == 0


LIMITS = {"text_clusters": 150, "cluster_areas": 400, "fused_texts_strict": 220, "overlap_pairs": 200, "overlap_examples": 150}


@pytest.mark.parametrize("name", LIMITS)
def test_pages_shuffle_rows_once(spark, sf_dir, name):
    """Bytes for each line item, without broadcasts (by cells: 298, 821, 318, 389, 327)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert moved(spark, lambda: QUERIES[name](spark, sf_dir)) < LIMITS[name] * X.texts(spark, sf_dir).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
