"""Ingest: upsert, counters, samples, encoders."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import require_dimension
from ..session import ship
from ..storage import shared_dir


def upsert(old: DataFrame, new: DataFrame, key: str = "point_id", version: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in or over it.

    Of equal keys in ``new`` the latest version wins, of equal or no versions the last row as the
    partitions and the rows in them are ordered.
    """
    numbered = new.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n"))
    order = F.struct(F.col(f"row.{version}"), "n") if version else F.col("n")
    last = numbered.groupBy(F.col(f"row.{key}").alias("k")).agg(F.max_by("row", order).alias("row")).select("row.*")
    last = last.drop(version) if version else last
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def etl_counters(outcomes: DataFrame) -> DataFrame:
    """One row of counts from rows of status (ok, failed, no_person), persons, faces."""
    status = F.col("status")
    count = lambda s: F.count_if(status == s)
    return outcomes.agg(
        F.count("*").alias("found"), count("ok").alias("processed"), count("failed").alias("failed"), count("no_person").alias("no_person"),
        F.coalesce(F.sum("persons"), F.lit(0)).alias("persons"), F.coalesce(F.sum("faces"), F.lit(0)).alias("faces"),
    )


def first_per_group(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def sample_then_filter(rows: DataFrame, key: str, n: int, keep, seed: int = 42) -> DataFrame:
    """n rows drawn by a seeded hash of the key, then those that ``keep`` lets through (fewer than n)."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n).where(keep)


def best_face(faces: DataFrame, group: str, threshold: float) -> DataFrame:
    """The face with the highest score of each group, the first of equals; weaker ones do not count."""
    kept = faces.where(F.col("det_score") >= threshold)
    other = [c for c in kept.columns if c != group]
    best = F.max_by(F.struct(*other), F.struct(F.col("det_score"), -F.col("face_no")))
    return kept.groupBy(group).agg(best.alias("b")).select(group, *[F.col(f"b.{c}") for c in other])


#: Bytes of an image and a camera number to a vector; loaded once in each Python worker.
Encoder = Callable[[bytes, int], np.ndarray]
#: Bytes of an image to its faces: bbox (4 numbers), embedding, det_score, age and gender (or None).
FaceDetector = Callable[[bytes], list[dict]]

#: Size (rows, columns), mean and deviation that the body encoder's input has.
INPUT_SIZE, INPUT_MEAN, INPUT_DEVIATION = (256, 128), 0.5, 0.5

#: Binary PPM of one byte a colour: one white space character stands before the pixels, whatever these are.
PPM_HEAD = rb"P6(?:\s+#[^\n]*(?=\n))*\s+(\d+)\s+(\d+)\s+255\s"


def decoded(content: bytes) -> np.ndarray:
    """(rows, columns, 3) bytes of an image; an unreadable one raises ValueError.

    Binary PPM is read here, all else by Pillow where it is installed.
    """
    head = re.match(PPM_HEAD, content)
    if head:
        width, height = int(head[1]), int(head[2])
        pixels = content[head.end() : head.end() + 3 * width * height]
        if len(pixels) == 3 * width * height:
            return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
    try:
        import io

        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    except Exception as e:
        raise ValueError(f"the image cannot be read: {e}") from None


def annotated(image: np.ndarray, boxes: list[tuple[int, int, int, int]], width: int = 2, color: tuple[int, int, int] = (0, 255, 0)) -> bytes:
    """A binary PPM of the image with the boxes (x1, y1, x2, y2) drawn on it; boxes are cut at the border."""
    out = image.copy()
    for x1, y1, x2, y2 in boxes:
        inner = out[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
        inner[:width], inner[-width:] = color, color
        inner[:, :width], inner[:, -width:] = color, color
    return b"P6\n%d %d\n255\n" % (out.shape[1], out.shape[0]) + out.tobytes()


def preprocessed(image: np.ndarray, size: tuple[int, int] = INPUT_SIZE, mean: float = INPUT_MEAN, deviation: float = INPUT_DEVIATION) -> np.ndarray:
    """(3, rows, columns) input of an encoder: bilinear resize, values of 0 to 1, mean and deviation taken out."""

    def weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = at.astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    x = image.astype(float) / 255
    a, b, w = weights(x.shape[0], size[0])
    x = x[a] * (1 - w)[:, None, None] + x[b] * w[:, None, None]
    a, b, w = weights(x.shape[1], size[1])
    x = x[:, a] * (1 - w)[None, :, None] + x[:, b] * w[None, :, None]
    return ((x - mean) / deviation).transpose(2, 0, 1)


def stub_encoder(dimension: int = 64) -> Encoder:
    """A deterministic encoder for tests: equal bytes give equal unit vectors."""

    def encode(image: bytes, camera: int = 0) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(image + bytes([camera % 256])).digest()[:8], "little")
        v = np.random.default_rng(seed).normal(size=dimension)
        return v / np.linalg.norm(v)

    return encode


def encode_images(images: DataFrame, load: Callable[[], Encoder], dimension: int, camera: str | None = None) -> DataFrame:
    """path, status, error, vector of every (path, content) row; a bad image is a failed row, not a failed job.

    ``camera`` names a column with the camera number that the encoder gets; without it, or where it is
    null, the number is 0.
    """
    ship(images.sparkSession)
    number = F.coalesce(F.col(camera).cast("int"), F.lit(0)) if camera else F.lit(0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            out = []
            for path, content, camera_id in zip(frame["path"], frame["content"], frame["camera"], strict=True):
                try:
                    v = np.asarray(encode(bytes(content), int(camera_id)), float)
                    if v.shape != (dimension,):
                        raise ValueError(f"a vector of {dimension} numbers is needed")
                    out.append((path, "ok", None, v.tolist()))
                except Exception as e:
                    out.append((path, "failed", str(e), None))
            yield pd.DataFrame(out, columns=["path", "status", "error", "vector"])

    return images.select("path", "content", number.alias("camera")).mapInPandas(run, "path string, status string, error string, vector array<double>")


FACES = "path string, face_no int, embedding array<double>, det_score double, bbox array<int>, age int, gender string"


def detect_faces(crops: DataFrame, load: Callable[[], FaceDetector], threshold: float = 0.5) -> DataFrame:
    """path, face_no, embedding, det_score, bbox, age, gender: a row for each face of a (path, content) row.

    The detector drops weak faces by its own threshold first; ``threshold`` can only raise it. A crop
    that the detector fails on has no faces. Embeddings are scaled to length 1 unless they are zero.
    """
    ship(crops.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    faces = detect(bytes(content))
                except Exception:
                    faces = []
                for n, f in enumerate(faces):
                    if f["det_score"] >= threshold:
                        v = np.asarray(f["embedding"], float)
                        length = np.linalg.norm(v)
                        v = v / length if length > 1e-12 else v
                        out.append((path, n, v.tolist(), float(f["det_score"]), [int(x) for x in f["bbox"]], f.get("age"), f.get("gender")))
            frame = pd.DataFrame(out, columns=["path", "face_no", "embedding", "det_score", "bbox", "age", "gender"])
            yield frame.astype({"age": "Int32", "gender": object, "face_no": "int32"})

    return crops.select("path", "content").mapInPandas(run, FACES)


def expand_images(images: DataFrame, load: Callable[[], Callable[[bytes], list[tuple[bytes, float]]]]) -> DataFrame:
    """path, crop_no, status, error, crop, confidence: each image's crops, one row each.

    An image without crops gives one no_person row, a failing image one failed row.
    """
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    crops = detect(bytes(content))
                    out += [(path, n, "ok", None, crop, float(c)) for n, (crop, c) in enumerate(crops, 1)] or [(path, 0, "no_person", None, None, None)]
                except Exception as e:
                    out.append((path, 0, "failed", str(e), None, None))
            yield pd.DataFrame(out, columns=["path", "crop_no", "status", "error", "crop", "confidence"])

    return images.select("path", "content").mapInPandas(run, "path string, crop_no int, status string, error string, crop binary, confidence double")


def write_points(points: DataFrame, path: str, reset: bool, signal: str = "reid", dimension: int = 64) -> None:
    """Write a points table; vectors of another dimension raise. ``reset`` replaces the table."""
    points.withColumn(signal, require_dimension(F.col(signal), dimension)).write.mode("overwrite" if reset else "append").parquet(path)


def write_crops(crops: DataFrame, folder: str) -> None:
    """Write (crop_name, crop) rows as files of a folder on a file system that pyarrow opens by its address.

    A folder without a scheme, or of the scheme file, is a machine's own unless it lies below the shared
    folder; others are taken in local mode only.
    """
    spark = crops.sparkSession
    local = lambda path: os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
    own = folder.startswith("file:") or "://" not in folder
    if own and not spark.sparkContext.master.startswith("local"):
        shared = shared_dir(spark)
        if not (shared.startswith("file:") or "://" not in shared) or os.path.commonpath([local(shared), local(folder)]) != local(shared):
            raise ValueError(f"{folder} is not shared by the executors")
    address = "file://" + local(folder) if own else folder

    def save(rows) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(address)
        system.create_dir(base, recursive=True)
        for row in rows:
            with system.open_output_stream(f"{base}/{row['crop_name']}") as f:
                f.write(bytes(row["crop"]))

    crops.select("crop_name", "crop").foreachPartition(save)


def write_metadata(points: DataFrame, path: str, order: str = "point_id") -> None:
    """Write the payload of every point as JSON lines in the order of its vectors; the vectors are left out."""
    kept = [c for c, kind in points.dtypes if not kind.startswith(("array<double>", "array<float>"))]
    points.select(*kept).orderBy(order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def copy_sample(rows: DataFrame, folder: str, column: str = "path") -> int:
    """Copy the files of a sample into a folder that is wiped first; the number of files.

    Files are copied one by one through Spark's file systems, so this is for samples, as
    ``first_per_group`` gives them.
    """
    spark = rows.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(folder)
    system = target.getFileSystem(conf)
    system.delete(target, True)
    system.mkdirs(target)
    n = 0
    for row in rows.select(column).toLocalIterator():
        source = hadoop.Path(row[0])
        hadoop.FileUtil.copy(source.getFileSystem(conf), source, system, hadoop.Path(target, source.getName()), False, conf)
        n += 1
    return n


def save_experiment(results: DataFrame, path: str, algorithm: str) -> None:
    """Append the rows of one finished experiment, so that a broken sweep keeps what it has."""
    results.withColumn("algorithm", F.lit(algorithm)).write.mode("append").partitionBy("algorithm").parquet(path)
