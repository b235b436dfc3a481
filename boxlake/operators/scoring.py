"""Batch scoring with functions the caller supplies.

A detector gets a pandas frame of tiles and returns one list of detections per row,
each `{class_id, class_name, confidence, x1, y1, x2, y2}`. A recogniser gets a frame of
regions and returns one `(texts, scores, polygons)` triple per row. The batch size is
`spark.sql.execution.arrow.maxRecordsPerBatch`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTION = (
    "array<struct<class_id:int,class_name:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"
)
TILE_RESULT = f"tile string, image_path string, detection_count int, error string, detections {DETECTION}"
OCR_ARRAYS = "rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>"
OCR_TYPES = (pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.list_(pa.float64()))))


def score_tiles(
    tiles: DataFrame, detector: Callable[[pd.DataFrame], list[list[dict]]], threshold: float = 0.25
) -> DataFrame:
    """Runs `detector` over batches of `tile, image_path, ...`. A batch that fails gives
    one error row per tile and the job goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"tile": batch["tile"], "image_path": batch["image_path"]})
            try:
                found = [[d for d in ds if d["confidence"] >= threshold] for ds in detector(batch)]
                if len(found) != len(batch):
                    raise ValueError(f"{len(found)} results for {len(batch)} tiles")
                out["detection_count"] = [len(ds) for ds in found]
                out["error"] = None
                out["detections"] = found
            except Exception as e:  # noqa: BLE001 - any failure of the caller's code
                out["detection_count"] = 0
                out["error"] = f"{type(e).__name__}: {e}"
                out["detections"] = [[] for _ in range(len(batch))]
            yield out

    return tiles.mapInPandas(run, TILE_RESULT)


def tile_detections(results: DataFrame) -> DataFrame:
    """Scored tiles as flat `tile_detections` rows."""
    flat = results.select("tile", F.posexplode("detections").alias("det_idx", "d"))
    return flat.select(
        "tile", F.col("det_idx").cast("long").alias("det_idx"), "d.class_id", "d.class_name", "d.confidence",
        *[F.col(f"d.{c}").alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")],
    )


def read_regions(
    rois: DataFrame, recogniser: Callable[[pd.DataFrame], list[tuple[list, list, list]]]
) -> DataFrame:
    """Runs `recogniser` over batches of `roi_boxes` rows; adds `rec_texts, rec_scores,
    rec_polys` and `error`. A batch that fails is read again in halves, down to single rows:
    only the rows that fail by themselves have no texts, and say why in `error`."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rois.schema.fields)

    def attempt(batch: pd.DataFrame) -> list[tuple]:
        read = [tuple(r) for r in recogniser(batch)]
        if len(read) != len(batch):
            raise ValueError(f"{len(read)} results for {len(batch)} regions")
        return read

    def read_in_halves(batch: pd.DataFrame, errors: list[str | None], lo: int, hi: int) -> list[tuple]:
        """Rows `lo` to `hi`, in halves where they can't be read at once."""
        try:
            return attempt(batch.iloc[lo:hi])
        except Exception as e:  # noqa: BLE001 - any failure of the caller's code
            if hi - lo == 1:
                errors[lo] = f"{type(e).__name__}: {e}"
                return [([], [], [])]
        middle = (lo + hi) // 2
        return read_in_halves(batch, errors, lo, middle) + read_in_halves(batch, errors, middle, hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            batch = rows.to_pandas()
            errors: list[str | None] = [None] * len(batch)
            read = read_in_halves(batch, errors, 0, len(batch)) if len(batch) else []
            added = [pa.array([r[i] for r in read], t) for i, t in enumerate(OCR_TYPES)]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *added, pa.array(errors, pa.string())], [*rows.schema.names, "rec_texts", "rec_scores", "rec_polys", "error"]
            )

    # reading costs far more than moving a row, and files may come as few splits with rows
    tasks = int(rois.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rois.repartition(tasks).mapInArrow(run, f"{schema}, {OCR_ARRAYS}, error string")
