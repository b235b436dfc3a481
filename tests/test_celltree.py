"""Points in boxes on the tree of cells against all pairs, with crowded cells and boxes of any size."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxlake.operators import celltree, dedup, fusion, spatial

BOX = "bx1 double, by1 double, bx2 double, by2 double"


def holds(b, x, y):
    return b[0] <= x <= b[2] and b[1] <= y <= b[3]


def random_box(rnd, sizes=(0, 1, 30, 200, 5000)):
    x, y = rnd.uniform(-300, 900), rnd.uniform(-300, 900)
    s = rnd.choice(sizes)
    return [x, y, x + rnd.uniform(0, s), y + rnd.uniform(0, s)]


@pytest.mark.parametrize("limit", [4, 60, 10**6])
def test_points_in_boxes_match_all_pairs(spark, limit):
    rnd = random.Random(limit)
    boxes = [(d, 1000 * k + i, *random_box(rnd)) for k, d in enumerate("ab") for i in range(60)]
    boxes += [("a", 100, float("nan"), 0, 1, 1), ("a", 101, None, 0, 1, 1), ("a", 102, 5, 5, 1, 1), (None, 103, 0, 0, 9, 9)]
    points = [(d, 1000 * k + i, rnd.uniform(-300, 900), rnd.uniform(-300, 900)) for k, d in enumerate("abc") for i in range(120)]
    # points on edges and corners, and a null
    points += [("a", 200 + i, b[2], b[3]) for i, b in enumerate(boxes[:30])] + [("a", 300, None, 1.0), (None, 301, 1.0, 1.0)]
    p = spark.createDataFrame([(d, i, x, y) for d, i, x, y in points], "doc string, p long, px double, py double")
    b = spark.createDataFrame([(d, i, *map(lambda v: None if v is None else float(v), r)) for d, i, *r in boxes], f"doc string, b long, {BOX}")
    want = {
        (i, j) for d, i, x, y in points for e, j, *r in boxes
        if d is not None and d == e and x is not None and None not in r and r[0] <= r[2] and holds(r, x, y)
    }
    got = [(r.p, r.b) for r in celltree.inside(p, b, ["doc"], pair_limit=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    near = {(r.doc, r.px, r.py) for r in celltree.touched(p, b, ["doc"], limit).collect()}
    at = {i: (d, x, y) for d, i, x, y in points}
    assert near == {at[i] for i, _ in want}


def test_boxes_of_any_size(spark):
    boxes = [("d", 0.0, 0.0, s, s) for s in (0.0, 1e-9, 1.0, 1e5, 1e9, 1e12, 1e300)] + [("d", -1e15, -5.0, 1e15, -4.0)]
    points = [("d", 0.5, 0.5), ("d", 1e8, 1e8), ("d", 9e11, 1.0), ("d", -1.0, -1.0), ("d", 1e14, -4.5), ("d", 1e299, 2.0), ("d", -7.0, 1e301)]
    p = spark.createDataFrame(points, "doc string, px double, py double")
    b = spark.createDataFrame(boxes, f"doc string, {BOX}")
    want = sorted((x, y) for _, x, y in points if any(holds(r, x, y) for _, *r in boxes))
    assert sorted((r.px, r.py) for r in celltree.touched(p, b, ["doc"]).collect()) == want
    pairs = sum(holds(r, x, y) for _, x, y in points for _, *r in boxes)
    assert celltree.inside(p, b, ["doc"]).count() == pairs


def crowd(n, seed, size):
    rng = np.random.RandomState(seed)
    x, y = rng.uniform(0, 90, n), rng.uniform(0, 90, n)
    return pd.DataFrame({
        "doc": "d", "page": 1, "x1": x, "y1": y, "x2": x + rng.uniform(0.01, size, n), "y2": y + rng.uniform(0.01, size, n),
    })


def test_crowded_cell_of_spans_and_boxes(spark):
    n = 20_000
    spans, boxes = crowd(n, 1, 3.0), crowd(n, 2, 0.05)
    spans["text"], spans["text_idx"] = [f"t{i}" for i in range(n)], range(n)
    start = time.perf_counter()
    got = spatial.spans_near_boxes(spark.createDataFrame(spans), spark.createDataFrame(boxes), expand=0.0, pair_limit=celltree.PAIR_LIMIT).select("text_idx").toPandas()
    assert time.perf_counter() - start < 60
    px, py = ((spans.x1 + spans.x2) / 2).to_numpy(), ((spans.y1 + spans.y2) / 2).to_numpy()
    b, want = boxes, []
    for lo in range(0, n, 1000):
        x, y = px[lo : lo + 1000, None], py[lo : lo + 1000, None]
        hit = ((b.x1.values <= x) & (x <= b.x2.values) & (b.y1.values <= y) & (y <= b.y2.values)).any(axis=1)
        want += (np.flatnonzero(hit) + lo).tolist()
    assert sorted(got.text_idx) == want and 0 < len(want) < n


def test_crowded_cell_of_texts_of_both_sources(spark):
    n = 20_000
    pdf = crowd(n, 3, 2.0).assign(text=[f"word {i % 700}" for i in range(n)], text_idx=range(n), source="pdf", confidence=1.0)
    ocr = pdf.copy()
    ocr["x2"] += 0.05
    ocr["text"] = [t if i % 2 else f"other {i}" for i, t in enumerate(pdf.text)]
    ocr["source"] = "ocr"
    start = time.perf_counter()
    got = fusion.fuse(spark.createDataFrame(pdf), spark.createDataFrame(ocr), pair_limit=celltree.PAIR_LIMIT).toPandas()
    assert time.perf_counter() - start < 90
    left = set(got[got.source == "ocr"].text)
    assert not any(t.startswith("word") for t in left) and sum(t.startswith("other") for t in left) == n // 2


@pytest.mark.parametrize("threshold", [0.5, 0.3, 0.8])
def test_pairs_match_all_pairs(spark, threshold):
    rnd = random.Random(7)
    rows = []
    for page in (1, 2):
        for i in range(80):
            x, y, s = rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.choice([5, 20, 60])
            rows.append(("d", page, i, "c", 0.5, x, y, x + s * rnd.uniform(0.7, 1), y + s * rnd.uniform(0.7, 1)))
        rows += [(*r[:2], 100 + k, *r[3:]) for k, r in enumerate(rows[-3:])]
    df = spark.createDataFrame(rows, "doc string, page int, det_idx long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")

    def iou(a, b):
        w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
        inter = w * h if w > 0 and h > 0 else 0.0
        return inter / ((a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - inter)

    want = {p: sorted((a[2], b[2]) for a in rows for b in rows if a[1] == b[1] == p and a[2] < b[2] and iou(a, b) > threshold) for p in (1, 2)}
    got = {r.page: r.overlapping_pairs for r in dedup.overlap_summary(df, threshold, pair_limit=50).collect()}
    assert got == {p: len(v) for p, v in want.items()}
    for block in (3, 256):
        first = dedup.overlap_sample(df, threshold, 7, block=block).select("page", "a_det_idx", "b_det_idx").collect()
        assert sorted(map(tuple, first)) == sorted((p, *ab) for p, v in want.items() for ab in v[:7])


def test_dense_cell_of_overlapping_boxes(spark):
    n = 6_000
    rng = np.random.RandomState(4)
    df = pd.DataFrame({"doc": "d", "page": 1, "det_idx": range(n), "class_name": "c", "confidence": 0.5, "x1": rng.uniform(0, 1, n), "y1": rng.uniform(0, 1, n)})
    df["x2"], df["y2"] = df.x1 + 100, df.y1 + 100
    boxes = spark.createDataFrame(df)
    got = dedup.overlap_summary(boxes, pair_limit=celltree.PAIR_LIMIT).collect()
    assert [(r.total_detections, r.overlapping_pairs) for r in got] == [(n, n * (n - 1) // 2)]
    first = dedup.overlap_sample(boxes, n=10, block=256).select("a_det_idx", "b_det_idx").collect()
    assert sorted(map(tuple, first)) == [(0, i) for i in range(1, 11)]
