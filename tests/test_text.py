import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from boxlake.functions import text as T
from boxlake.operators import fusion

# Golden rows: texts with the patterns and relevance worked out by hand.
GOLDEN = [
    ("I0.1", "input,numeric,label", 17.8),
    ("Q2.3", "output,numeric,label", 17.8),
    ("M1.5", "memory,numeric,label", 16.8),
    ("T10", "timer,variable,numeric,label", 20.6),
    ("C5", "counter,numeric,label", 15.4),
    ("FB12", "function_block,variable,numeric,label", 19.8),
    ("DB3", "data_block,variable,numeric,label", 19.6),
    ("AI1", "analog_input,variable,numeric,label", 18.6),
    ("AO2", "analog_output,variable,numeric,label", 18.6),
    ("MOTOR_START", "variable,label", 10.0),
    ("VALVE_OPEN", "variable,label", 10.0),
    ("123.45", "numeric", 6.2),
    ("SENSOR_1", "variable,numeric,label", 13.6),
    ("random_text", "variable,label", 10.0),
]


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")


def test_golden_tags(spark):
    df = fusion.tag(frame(spark, [f" {t} " for t, _, _ in GOLDEN]))
    rows = df.select("i", "text", F.array_join("patterns.pattern", ",").alias("p"), "relevance").orderBy("i").collect()
    assert [(r.text, r.p, r.relevance) for r in rows] == GOLDEN


def test_blank_texts_are_dropped(spark):
    assert fusion.tag(frame(spark, ["", "  ", "\t ", "x"])).count() == 1


def test_unicode_digits_and_letters(spark):
    df = frame(spark, ["größe 1", "GRÖSSE-1", "T٣"])
    rows = df.select(T.normalised(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows] == ["größe1", "grösse1", "t٣"]
    tags = df.filter("i = 2").select(F.array_join(T.matched_patterns(F.col("text"))["pattern"], ",").alias("p"))
    assert tags.collect()[0].p == "timer,numeric"


def test_user_patterns(spark):
    mine = [T.TextPattern("wire", r"W\d+", 4, "Wires")]
    df = fusion.tag(frame(spark, ["w12", "x"]), mine)
    assert [r.relevance for r in df.orderBy("i").collect()] == [pytest.approx(1 + 4 + 0.6 + 1), pytest.approx(1.2)]


def test_alphanumeric_order(spark):
    df = frame(spark, ["M10", "M2", "2A", "A", "", "M007", "M" + "9" * 45, "M1" + "0" * 45])
    key = T.alphanumeric_key(F.col("text"), F.lit(0.0), F.lit(0.0))
    got = [r.text for r in df.orderBy(key, "i").collect()]
    assert got == ["2A", "A", "M2", "M007", "M10", "M" + "9" * 45, "M1" + "0" * 45, ""]


def test_padding_keeps_long_and_negative_numbers(spark):
    df = spark.createDataFrame([(7,), (1234,), (-1,)], "n bigint")
    assert [r[0] for r in df.select(T.padded(F.col("n"))).collect()] == ["007", "1234", "-01"]


def test_similarity_needs_containment(spark):
    df = spark.createDataFrame([("motor", "motor1"), ("motor", "moter"), ("", "a"), ("a", "a")], "a string, b string")
    assert [r[0] for r in df.select(T.similar(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_order_columns_sort_like_the_key(spark):
    texts = ["A", "AB", "A B", "a10", "A9", "A09", "A9B", "9", "10", "007", "7a", "٣", "٣0", "-", "", "Z", "ZZ1", "1Z", None]
    data = [(t, x, y) for t in texts for x in (0.0, 1.5, None) for y in (2.0, -1.0)]
    df = spark.createDataFrame(data, "t string, x double, y double").coalesce(1)
    place = [F.col(c) for c in "txy"]
    ranks = [F.dense_rank().over(Window.orderBy(*c)) for c in ([T.alphanumeric_key(*place)], T.alphanumeric_order(*place))]
    assert df.select(ranks[0].alias("a"), ranks[1].alias("b")).filter("a <> b").count() == 0


def test_padded_numbers_are_those_of_a_format(spark):
    df = spark.range(-1200, 1200).union(spark.createDataFrame([(None,), (10**12,)], "id long"))
    assert df.filter(~T.padded(F.col("id")).eqNullSafe(F.format_string("%03d", "id"))).count() == 0
