"""Ordinals in one plan."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from boxlake.operators import areas, calibrate, catalog, ranking


def jobs_of(spark, build):
    """Jobs started while `build` makes a plan."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "building")
    try:
        build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def data(spark, n=3000):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None, f"k{i}"]), rnd.choice([None, 1.5, 2.5, rnd.random()]), rnd.choice("xyz"), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v double, s string, i long")


@pytest.mark.parametrize("hot", [1, 40, 1_000_000])
def test_numbers_are_those_of_a_plain_sort(spark, hot):
    rows, df = data(spark)
    order = [F.col("v"), ranking.Falling(F.col("s")), F.col("i")]
    got = {r.i: r.n for r in ranking.numbered(df.repartition(5), ["k"], order, "n", hot=hot).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for group in groups.values():
        group.sort(key=lambda r: (r[1] is not None, r[1] or 0, -ord(r[2]), r[3]))
        assert [got[r[3]] for r in group] == list(range(1, len(group) + 1))
    assert len(got) == len(rows)


def test_falling_values_put_nulls_last(spark):
    _, df = data(spark)
    rows = ranking.numbered(df, [], [ranking.Falling(F.col("v")), F.col("i")], "n", hot=100).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, len(rows) + 1))
    want = sorted(rows, key=lambda r: (r.v is None, -(r.v or 0), r.i))
    assert [r.i for r in rows] == [r.i for r in want]


def test_building_a_ranking_starts_no_job(spark):
    _, df = data(spark)
    assert jobs_of(spark, lambda: df.count()) > 0
    assert jobs_of(spark, lambda: ranking.numbered(df, ["k"], [F.col("i")], "n", hot=10)) == 0


def test_rows_are_shuffled_once(spark):
    """The sizes of ranges come from the same shuffle as the rows."""
    _, df = data(spark)
    spark.range(0)  # a session with its usual settings
    out = ranking.numbered(df, ["k"], [F.col("i")], "n", hot=10)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("hot", [4, 100, 10_000])
def test_medians_are_exact(spark, hot):
    rnd = random.Random(hot)
    rows = []
    for doc, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000)):
        rows += [(doc, rnd.choice([rnd.gauss(0, 1e6), float(rnd.randrange(5))]), rnd.gauss(5, 1), 0.0, 0.0) for _ in range(n)]
    df = spark.createDataFrame(rows, "doc string, x1 double, y1 double, sym_x1 double, sym_y1 double")
    got = {r.doc: r for r in calibrate.offset_statistics(df, hot=hot).collect()}
    for doc in "abcd":
        for axis, i in (("x", 1), ("y", 2)):
            v = sorted(r[i] for r in rows if r[0] == doc)
            assert got[doc][f"median_{axis}"] == pytest.approx((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, rel=1e-12)
        assert got[doc].sample_count == sum(r[0] == doc for r in rows)


def test_one_shuffle_carries_whole_rows(spark):
    """Beside it only cuts and the sizes of ranges are dealt by key."""
    _, df = data(spark)
    out = ranking.numbered(df, ["k"], [F.col("i")], "n", hot=10).drop("s")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 1


def test_retention_settles_equal_times_and_names_by_path(spark):
    rows = [("o", "n", f"/{i % 7}{i}", 5) for i in range(40)]
    for data in (rows, rows[::-1]):
        df = spark.createDataFrame(data, "owner string, name string, path string, modified int").coalesce(1)
        kept = catalog.retention(df, 3, "owner").filter("action = 'keep'").collect()
        assert sorted(r.path for r in kept) == sorted(r[2] for r in rows)[-3:]


def test_rows_to_sequence_are_made_once(spark):
    """Numbering reads its input three times; a costly one is written first."""
    made = spark.sparkContext.accumulator(0)

    def read(i):
        made.add(1)
        return f"T{i % 17}"

    rows = spark.range(400).select(
        (F.col("id") % 3).alias("document"), F.lit(1).alias("page"), F.lit("area_Tag-ID_000_000").alias("area_id"), F.col("id").alias("text_idx"),
        F.udf(read, "string")("id").alias("text_content"), *[F.lit(1.0).alias(c) for c in ("x", "y", "width", "height")],
    )
    areas.sequenced(rows, hot=20).collect()
    assert made.value == 400
    areas.tag_rows(rows).collect()
    assert made.value == 800
