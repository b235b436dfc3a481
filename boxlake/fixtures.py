"""Page, tile, box and text tables derived from the TPC-H-like tables.

Every row of the source table gives one row here. Coordinates are whole numbers and
confidences multiples of 1/128, so sums do not depend on the order of rows. The same
arithmetic is stated in SQL in `boxlake.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.functions import geometry as G
from boxlake.operators.tiles import tile_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores when the files come as fewer splits than there are cores, as
    small test tables do. Larger tables are left as scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _lineitem(spark, sf_dir):
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


def _ordinal():
    # orders repeat line numbers: part and price tell such lines apart
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    low = F.pmod(F.col("l_partkey") * 7919 + cents, F.lit(262144))
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 262144 + low


def _page():
    return (F.pmod("l_orderkey", F.lit(4)) + 1).cast("int")


def _page_size(doc, page):
    return {
        "page_w": (2700 + F.pmod(doc, F.lit(5)) * 25).cast("int"),
        "page_h": (2150 + page * 10).cast("int"),
    }


def _box():
    q = F.col("l_quantity").cast("int")
    x1 = F.pmod("l_partkey", F.lit(20)) * 140 + F.pmod("l_orderkey", F.lit(23))
    y1 = F.pmod("l_orderkey", F.lit(16)) * 140 + F.pmod("l_partkey", F.lit(19))
    return G.Box(x1, y1, x1 + 40 + q, y1 + 30 + F.col("l_linenumber") * 5)


def _confidence():
    return (28 + F.round(F.col("l_discount") * 1000).cast("int")) / F.lit(128.0)


def _class():
    flag = F.col("l_returnflag")
    return F.when(flag == "A", "Tag-ID").when(flag == "N", "resistor").otherwise("connector")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per line item, with the tile it came from."""
    flag = F.col("l_returnflag")
    base = _lineitem(spark, sf_dir).select(
        F.col("l_suppkey").alias("doc"),
        _page().alias("page"),
        _ordinal().alias("det_idx"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("class_id"),
        _class().alias("class_name"),
        _confidence().alias("confidence"),
        *[c.cast("double").alias(n) for n, c in G.as_columns(_box()).items()],
    )
    sized = base.withColumns(_page_size(F.col("doc"), F.col("page")))
    col = F.least(F.lit(2), F.floor(F.col("x1") / 1000)).cast("int")
    row = F.least(F.lit(2), F.floor(F.col("y1") / 700)).cast("int")
    placed = sized.withColumns({"row": row, "col": col})
    ox = F.when(F.col("col") == 2, F.col("page_w") - 1500).otherwise(F.col("col") * 1000)
    oy = F.when(F.col("row") == 2, F.col("page_h") - 1200).otherwise(F.col("row") * 700)
    tile_box = G.shift(G.box(), -ox, -oy)
    return placed.withColumns(G.as_columns(tile_box, "t")).withColumn(
        "tile", tile_name(F.col("doc"), F.col("page"), F.col("row"), F.col("col"))
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages per supplier; the fifth has no boxes."""
    base = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page")
    )
    return base.withColumns(_page_size(F.col("doc"), F.col("page")))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order, of widely varying size."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"),
        key.cast("int").alias("page"),
        (900 + F.pmod(key * 37, F.lit(4100))).cast("int").alias("page_w"),
        (700 + F.pmod(key * 53, F.lit(3300))).cast("int").alias("page_h"),
    )


def tile_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of `detections` in tile coordinates."""
    d = detections(spark, sf_dir)
    return d.select(
        "tile", "det_idx", "class_id", "class_name", "confidence",
        *[F.col(f"t{n}").alias(f"b{n}") for n in G.Box._fields],
    )


def _text():
    part, order, line = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    q = F.col("l_quantity").cast("int").cast("string")

    def s(c):
        return c.cast("string")

    blank_or_counter = F.when(F.pmod(part, F.lit(2)) == 0, "  ").otherwise(F.concat(F.lit("C"), s(F.pmod(part, F.lit(90)))))
    return (
        F.when(line == 1, F.concat(F.lit("I"), s(F.pmod(part, F.lit(10))), F.lit("."), q))
        .when(line == 2, F.concat(F.lit(" Q"), s(F.pmod(order, F.lit(10))), F.lit("."), q, F.lit(" ")))
        .when(line == 3, F.concat(F.lit("DB"), s(part)))
        .when(line == 4, F.concat(F.lit("Motor_"), s(F.pmod(order, F.lit(7)))))
        .when(line == 5, F.concat(F.lit("T"), s(F.pmod(part, F.lit(50)))))
        .when(line == 6, F.concat(F.lit("Valve "), s(F.pmod(order, F.lit(100)))))
        .otherwise(blank_or_counter)
    )


def _text_box():
    b = _box()
    x1 = b.x1 + F.pmod("l_partkey", F.lit(7)) * 30 - 60
    y1 = b.y1 + F.pmod("l_orderkey", F.lit(5)) * 40 - 80
    return G.Box(x1, y1, x1 + 10 * F.length("text"), y1 + 12)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One PDF text span per line item."""
    base = _lineitem(spark, sf_dir).withColumn("text", _text())
    return base.select(
        F.col("l_suppkey").alias("doc"), _page().alias("page"), _ordinal().alias("text_idx"), "text",
        *[c.cast("double").alias(n) for n, c in G.as_columns(_text_box()).items()],
    )


def _ocr_columns():
    q = F.col("l_quantity").cast("int")
    kind = F.pmod(q, F.lit(3))
    read = F.when(kind == 0, F.lower("text")).when(kind == 1, F.concat("text", F.lit("X"))).otherwise(
        F.concat(F.lit("N"), F.col("l_partkey").cast("string"))
    )
    b = G.shift(_text_box(), F.pmod(q, F.lit(4)) * 8, F.lit(0))
    return [
        F.col("l_suppkey").alias("doc"), _page().alias("page"), _ordinal().alias("text_idx"), read.alias("text"),
        ((64 + F.pmod("l_partkey", F.lit(64))) / F.lit(128.0)).alias("confidence"),
        *[c.cast("double").alias(n) for n, c in G.as_columns(b).items()],
        F.lit("ocr").alias("source"),
        F.when(_known(), _ordinal()).alias("sym_idx"),
    ]


def _known():
    return F.pmod(F.col("l_quantity").cast("int"), F.lit(2)) == 0


def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recognised text per line item: a third reads like the span, a third contains
    it, a third differs. Every second one knows its symbol."""
    return _lineitem(spark, sf_dir).withColumn("text", _text()).select(*_ocr_columns())


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans as texts of the PDF layer, before any association."""
    return spans(spark, sf_dir).withColumns(
        {"confidence": F.lit(1.0), "source": F.lit("pdf"), "sym_idx": F.lit(None).cast("long")}
    )


def linked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recognised texts with their symbol expanded, NULL for every second one."""
    base = _lineitem(spark, sf_dir).withColumn("text", _text())
    return base.select(
        *_ocr_columns(),
        F.when(_known(), _class()).alias("sym_class_name"),
        *[F.when(_known(), c.cast("double")).alias(f"sym_{n}") for n, c in G.as_columns(_box()).items()],
        F.when(_known(), F.least(F.lit(2), F.floor(_box().y1 / 700)).cast("int")).alias("row"),
        F.when(_known(), F.least(F.lit(2), F.floor(_box().x1 / 1000)).cast("int")).alias("col"),
    )


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and output sizes and a rotation per page; scale factors are powers of two."""
    p = pages(spark, sf_dir)
    return p.select(
        "doc", "page",
        F.col("page_w").alias("image_w"), F.col("page_h").alias("image_h"),
        (F.col("page_w") / 2).alias("out_w"), (F.col("page_h") / 2).alias("out_h"),
        (F.pmod("page", F.lit(4)) * 90).alias("rotation"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stage records: the user is the run, the type the stage."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("run"),
        F.col("event_type").alias("stage"),
        (F.col("event_type") != "error").alias("success"),
        (F.pmod("event_id", F.lit(7)) == 0).alias("skipped"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.col("value").alias("duration"),
        "ts",
    )


def tile_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tile results in batches: the user is the tile, the hour the batch."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("tile_"), F.col("user_id").cast("string"), F.lit(".png")).alias("tile"),
        F.when(failed, F.col("props")).alias("error"),
        F.when(failed, 0).otherwise(F.floor("value")).cast("long").alias("detection_count"),
        F.col("event_id").alias("batch_id"),
    )


def benchmark_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rolled up as benchmark rows per pipeline and batch size."""
    e = table(spark, sf_dir, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return e.groupBy(
        F.col("event_type").alias("pipeline"), F.pow(F.lit(2), F.pmod("user_id", F.lit(4)) + 3).cast("int").alias("batch_size")
    ).agg(F.count(F.lit(1)).alias("items"), (cents / 100.0).alias("seconds")).withColumn("success", F.col("pipeline") != "error")


def detection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result file names, one per customer, in the spellings found in folders."""
    key = F.col("c_custkey")
    kind = F.pmod(key, F.lit(4))
    suffix = F.when(kind == 0, "_detections.json").when(kind == 1, "_detections_converted.json").when(
        kind == 2, "_converted.json"
    ).otherwise("__detections.json")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("/in/"), F.col("c_name"), suffix).alias("path"))
