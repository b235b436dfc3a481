"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxlake.llm import negatives
from tests.llm.helpers import rows

SCHEMA = "vec_id long, label int, vec array<float>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(data, every=10):
    fine = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in data if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    best = lambda pairs: sorted({i: s for s, i in sorted(pairs)}.items(), key=lambda p: (-p[1], p[0]))
    out = []
    for a in sorted({i for i, _, _ in fine if i % every == 0}):
        _, label, v = min(r for r in fine if r[0] == a)
        positives = best((dot(v, w), i) for i, l, w in fine if l == label and i != a)[:5]
        for p, s in positives:
            inside = [(dot(v, w), i) for i, l, w in fine if l != label and 50 * s <= 100 * dot(v, w) <= 95 * s]
            out += [(a, p, k, i, s, n) for k, (i, n) in enumerate(best(inside)[:3], 1)]
    return sorted(out)


def check(spark, data, every=10):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = sorted(rows(negatives.mine(df, F.col("vec_id") % every == 0), *COLUMNS))
    assert got == plain(data, every)
    return got


def vectors(rnd, n, labels, spread, dims=6):
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, rnd.randrange(labels), [float(np.float32(x + rnd.gauss(0, spread))) for x in rnd.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("spread, labels", [(0.05, 2), (0.5, 3), (2.0, 10)])
def test_matches_all_pairs(spark, spread, labels):
    assert check(spark, vectors(random.Random(int(spread * 100)), 700, labels, spread), every=3)


def test_ties_repeats_and_awkward_rows(spark):
    rnd = random.Random(8)
    data = vectors(rnd, 200, 2, 0.01)
    data += [(1000 + i, i % 2, [1.0] * 6) for i in range(150)]  # one very common vector
    data += [(10, 0, [1.0] * 6), (10, 0, [1.0] * 6), (10, 1, [0.5] * 6), (1000, 0, [1.0] * 6)]  # repeated ids
    data += [(None, 0, [1.0] * 6), (2000, None, [1.0] * 6), (2010, 0, None), (2020, 0, [1.0, None]), (2030, 1, [float("nan")] * 6), (2040, 1, [float("inf")] * 6)]
    data += [(3000, 0, []), (3010, 1, [2.0, 2.0]), (3020, 0, [3.0] * 9), (-20, 1, [-1.0] * 6)]
    assert check(spark, data)


def test_large_components(spark):
    data = [(i, i % 2, [float(2**24 + 1000 * i), 2.0**23]) for i in range(40)]
    assert check(spark, data)


def test_without_partners(spark):
    assert check(spark, []) == []
    assert check(spark, [(0, 1, [1.0])]) == []
    assert check(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []


def test_bounds_skip_candidates_far_off():
    rnd = np.random.RandomState(1)
    centres = rnd.randint(-100, 100, (4, 16))
    x = centres[rnd.randint(0, 4, 2000)] + rnd.randint(-2, 3, (2000, 16))
    order, parents, edges = negatives.spanning_tree(x[:100])
    table = pa.table({
        "vec_id": np.arange(100)[order], "label": np.zeros(100, np.int32), "vec": pa.array(x[:100][order].tolist(), pa.list_(pa.int64())),
        "pivot": np.zeros(100, np.int64), "block": np.zeros(100, np.int64), "place": np.arange(100), "parent": parents, "edge": edges,
        "floors": [[-(1 << 63)]] * 100, "tops": [[(1 << 63) - 1]] * 100,
    })
    state = negatives._Search(table, True, 5)
    for lo in range(100, 2000, 190):
        state.add(np.arange(lo, lo + 190), np.zeros(190, np.int32), x[lo : lo + 190])
    assert state.met == 190_000 and state.scored < 0.5 * state.met
