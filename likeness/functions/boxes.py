"""Detection boxes as columns: clamping, size filters, area share, crop names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Smallest crop and detection thresholds.
MIN_WIDTH, MIN_HEIGHT = 90, 120
CONFIDENCE, SMALL_CONFIDENCE = 0.5, 0.3


def clamp(value: Column, most: Column) -> Column:
    """Truncate to an integer, then keep within [0, most]."""
    return F.least(F.greatest(value.cast("int"), F.lit(0)), most)


def clamped(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """x1, y1, x2, y2 clamped to the image; the boxes of zero area are still there."""
    return boxes.withColumns({"x1": clamp(F.col("x1"), width), "y1": clamp(F.col("y1"), height), "x2": clamp(F.col("x2"), width), "y2": clamp(F.col("y2"), height)})


def not_empty() -> Column:
    return (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))


def large_enough(min_width: int = MIN_WIDTH, min_height: int = MIN_HEIGHT) -> Column:
    return (F.col("x2") - F.col("x1") >= min_width) & (F.col("y2") - F.col("y1") >= min_height)


def area_percent(width: Column, height: Column) -> Column:
    """Share of the image that the unclamped box covers, in percent."""
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (width * height) * 100


def persons(boxes: DataFrame, threshold: float = CONFIDENCE, class_name: str = "person") -> DataFrame:
    return boxes.where((F.col("class_name") == class_name) & (F.col("confidence") >= threshold))


def with_crop_names(crops: DataFrame, image: str, order: str) -> DataFrame:
    """crop_name `<image>_person_<n>.jpg`, n from 1 within the image by ``order``."""
    n = F.row_number().over(Window.partitionBy(image).orderBy(order))
    return crops.withColumn("crop_no", n).withColumn("crop_name", F.concat(F.col(image).cast("string"), F.lit("_person_"), F.col("crop_no").cast("string"), F.lit(".jpg")))
