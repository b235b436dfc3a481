"""Roll-ups over detections, tile results, run logs and benchmark rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_counts(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections per page, 0 for pages without any."""
    counted = detections.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n"))
    return pages.select("doc", "page").join(counted, ["doc", "page"], "left").select(
        "doc", "page", F.coalesce("n", F.lit(0)).alias("detections")
    )


def class_counts(detections: DataFrame, keys: Sequence[str] = ("doc",)) -> DataFrame:
    return detections.groupBy(*keys, "class_name").agg(F.count(F.lit(1)).alias("n"))


def detection_statistics(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """Per document: pages, detections, confidence range and mean (0 when empty)."""
    p = pages.groupBy("doc").agg(F.countDistinct("page").alias("total_pages"))
    conf = F.col("confidence")
    d = detections.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(conf).alias("lo"),
        F.greatest(F.lit(0.0), F.max(conf)).alias("hi"),
        F.avg(conf).alias("mean"),
    )
    zero = F.lit(0.0)
    return p.join(d, "doc", "left").select(
        "doc",
        "total_pages",
        F.coalesce("n", F.lit(0)).alias("total_detections"),
        F.coalesce("lo", zero).alias("min_confidence"),
        F.coalesce("hi", zero).alias("max_confidence"),
        F.coalesce("mean", zero).alias("avg_confidence"),
    )


def tile_summary(tile_results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tiles scored, failed ones, boxes found, mean boxes over the successful."""
    ok = F.count_if(F.col("error").isNull())
    found = F.coalesce(F.sum("detection_count"), F.lit(0))
    return tile_results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_images"),
        ok.alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        found.alias("total_detections"),
        F.coalesce(F.try_divide(found, ok), F.lit(0.0)).alias("average_detections"),
    )


def latest_tile_results(tile_results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """One row per tile: the one of the last batch."""
    whole = F.struct(*tile_results.columns)
    return tile_results.groupBy("tile").agg(F.max_by(whole, F.col(batch)).alias("_r")).select("_r.*")


def run_summary(run_log: DataFrame) -> DataFrame:
    """Per run: stages run and skipped, wall time, outcome, progress."""
    end = F.unix_micros(F.col("ts").cast("timestamp"))
    start = end - F.round(F.col("duration") * 1e6).cast("long")
    done = F.count_if(F.col("success"))
    return run_log.groupBy("run").agg(
        F.count_if(~F.col("skipped")).alias("stages_run"),
        F.count_if("skipped").alias("stages_skipped"),
        ((F.max(end) - F.min(start)) / 1e6).alias("total_duration"),
        F.bool_and("success").alias("success"),
        done.alias("completed_stages"),
        F.count(F.lit(1)).alias("total_stages"),
        (done / F.count(F.lit(1))).alias("overall_progress"),
    )


def speeds(metrics: DataFrame) -> DataFrame:
    """Adds `speed` (items per second, 0 without a time) to benchmark rows."""
    return metrics.withColumn(
        "speed", F.when(F.col("seconds") > 0, F.try_divide("items", "seconds")).otherwise(0.0)
    )


def compare_to_baseline(metrics: DataFrame, baseline: str) -> DataFrame:
    """Speed of each successful configuration against the baseline pipeline at the
    same batch size: factor and percent change."""
    done = speeds(metrics.filter("success"))
    base = done.filter(F.col("pipeline") == baseline).select("batch_size", F.col("speed").alias("baseline_speed"))
    base = base.filter("baseline_speed > 0")
    ratio = F.col("speed") / F.col("baseline_speed")
    return (
        done.join(base, "batch_size")
        .withColumn("speedup", ratio)
        .withColumn("improvement_percent", (ratio - 1) * 100)
    )


def best_configuration(metrics: DataFrame) -> DataFrame:
    """The fastest successful row; the first one by pipeline and batch size on ties."""
    done = speeds(metrics.filter("success"))
    key = F.struct((-F.col("speed")).alias("s"), F.col("pipeline"), F.col("batch_size"))
    return done.agg(F.min_by(F.struct(*done.columns), key).alias("_r")).filter("_r is not null").select("_r.*")


def timing_breakdown(timings: DataFrame, total: str = "total_batch") -> DataFrame:
    """Mean milliseconds per component and share of the total component's time."""
    per = timings.groupBy("component").agg(F.avg("seconds").alias("mean"), F.sum("seconds").alias("spent"))
    whole = timings.filter(F.col("component") == total).agg(F.sum("seconds").alias("whole"))
    # `whole` is a global aggregate: always exactly one row
    return per.join(F.broadcast(whole)).select(
        "component",
        (F.col("mean") * 1000).alias("avg_ms"),
        F.when(F.col("component") == total, 100.0)
        .otherwise(F.try_divide("spent", "whole") * 100)
        .alias("percent"),
    )
