import pytest
from pyspark.sql import functions as F

from boxlake.operators import dedup
from helpers import detections, greedy, iou, random_boxes


def kept(df):
    return {r.det_idx for r in df.collect()}


@pytest.mark.parametrize("threshold,inclusive", [(0.5, False), (0.2, True)])
def test_fold_is_greedy(spark, threshold, inclusive):
    rows = random_boxes(150, seed=1)
    out = dedup.suppress(detections(spark, rows), threshold, inclusive=inclusive)
    assert kept(out) == greedy(rows, threshold, inclusive)


@pytest.mark.parametrize("threshold,inclusive,limit", [(0.5, True, 1000), (0.2, False, 40)])
def test_distributed_route_equals_fold(spark, threshold, inclusive, limit):
    """The route for large groups, also with crowded cells (small cell limit)."""
    rows = random_boxes(150, seed=2, page=150)
    out = dedup.suppress(detections(spark, rows), threshold, inclusive=inclusive, fold_limit=10, cell_limit=limit)
    assert kept(out) == greedy(rows, threshold, inclusive)


def test_small_and_large_groups_together(spark):
    big, small = random_boxes(120, seed=3, page=150), random_boxes(20, seed=4)
    df = detections(spark, big, page=1).unionByName(detections(spark, small, page=2))
    out = dedup.suppress(df, 0.5, fold_limit=50)
    assert kept(out.filter("page = 1")) == greedy(big, 0.5)
    assert kept(out.filter("page = 2")) == greedy(small, 0.5)
    assert set(out.columns) == set(df.columns)


def test_group_of_copies_collapses(spark):
    rows = [(i, 0.5 + (i % 3) / 10, (10, 10, 50, 50)) for i in range(300)]
    out = dedup.suppress(detections(spark, rows), 0.5, fold_limit=10, cell_limit=20)
    assert kept(out) == {2}


def test_classes_do_not_suppress_each_other(spark):
    a = detections(spark, [(0, 0.9, (0, 0, 10, 10))], cls="A")
    b = detections(spark, [(1, 0.8, (0, 0, 10, 10))], cls="B")
    df = a.unionByName(b)
    assert kept(dedup.suppress(df, 0.5)) == {0, 1}
    assert kept(dedup.suppress(df, 0.5, class_specific=False)) == {0}


@pytest.mark.parametrize("fold_limit", [100, 1])
def test_rows_without_box(spark, fold_limit):
    df = detections(spark, [(0, 0.9, (0, 0, 10, 10)), (1, 0.8, (0, 0, 10, 10)), (2, 0.7, (0, 0, 0, 10))])
    none = df.filter("det_idx = 0").withColumns({"x1": F.lit(None).cast("double"), "det_idx": F.lit(9).cast("long")})
    both = df.unionByName(none)
    assert kept(dedup.suppress(both, 0.5, fold_limit=fold_limit)) == {0, 2, 9}
    assert kept(dedup.suppress(both, 0.5, unboxed="drop", fold_limit=fold_limit)) == {0, 2}
    assert kept(dedup.suppress(none, 0.5, unboxed="drop")) == {9}


def test_boundary_is_kept_unless_inclusive(spark):
    # intersection 50, union 100: IoU exactly one half
    rows = [(0, 0.9, (0, 0, 10, 10)), (1, 0.8, (0, 0, 10, 5))]
    for limit in (100, 1):
        assert kept(dedup.suppress(detections(spark, rows), 0.5, fold_limit=limit)) == {0, 1}
        assert kept(dedup.suppress(detections(spark, rows), 0.5, inclusive=True, fold_limit=limit)) == {0}


def test_only_tags_are_deduplicated(spark):
    rows = [(0, 0.9, (0, 0, 10, 10)), (1, 0.8, (0, 0, 10, 9))]
    assert kept(dedup.dedup_tags(detections(spark, rows, cls="Tag-ID"))) == {0}
    assert kept(dedup.dedup_tags(detections(spark, rows, cls="relay"))) == {0, 1}


def test_preprocess_counts(spark):
    rows = [(0, 0.9, (0, 0, 10, 10)), (1, 0.8, (0, 0, 10, 9)), (2, 0.1, (50, 50, 60, 60))]
    df = detections(spark, rows)
    out = dedup.preprocess(df)
    assert kept(out) == {0}
    by_page = dedup.reduction_by_page(df, out)
    assert dedup.reduction_summary(by_page).collect()[0].reduction_percentage == pytest.approx(200 / 3)


def test_overlap_counts_with_copies(spark):
    rows = random_boxes(200, seed=5, page=250, copies=0.4)
    pairs = [(i, j) for i, _, a in rows for j, _, b in rows if i < j and iou(a, b) > 0.5]
    row = dedup.overlap_summary(detections(spark, rows), 0.5).collect()[0]
    assert (row.total_detections, row.overlapping_pairs) == (200, len(pairs))
    sample = dedup.overlap_sample(detections(spark, rows), 0.5, 10).collect()
    assert sorted((r.a_det_idx, r.b_det_idx) for r in sample) == sorted(pairs)[:10]


def test_overlap_sample_of_many_copies(spark):
    rows = [(i, 0.5, (0, 0, 10, 10)) for i in range(40)]
    sample = dedup.overlap_sample(detections(spark, rows), 0.5, 10).collect()
    assert sorted((r.a_det_idx, r.b_det_idx) for r in sample) == [(0, j) for j in range(1, 11)]
