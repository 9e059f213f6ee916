"""Exact cosine search: one query, many queries, several signals, and their fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import linear_rank_score
from ..functions.vectors import TINY, as_double, cosine
from .pairs import nearest

#: Fixed values of the fusion: weights of the two signals and hits taken of each.
REID_WEIGHT, FACE_WEIGHT, TOP_K_PER_SIGNAL = 0.6, 0.4, 50


def top_k(points: DataFrame, query: list[float] | None, signal: str, k: int, id_column: str = "point_id") -> DataFrame:
    """The k points most similar to a query vector: rank from 1, similarity in 4 decimals.

    Fewer rows than k if there are fewer points; no rows without a query vector.
    """
    rows = _similarities(points.where(F.col(signal).isNotNull()), query, signal, k, id_column)
    best = rows.orderBy(F.desc(F.round("raw", 12)), id_column).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("raw", 12)), id_column))  # k rows only
    return best.select(F.col(id_column), rank.alias("rank"), F.round("raw", 4).alias("similarity"), F.col("raw"))


def _similarities(points: DataFrame, query: list[float] | None, signal: str, k: int, id_column: str) -> DataFrame:
    """id and cosine of the rows that may be among the k best: each batch keeps its own k best and their ties.

    One matrix product a batch; vectors of another length than the query raise.
    """
    kind = points.schema[id_column].dataType.simpleString()
    if query is None:
        return points.sparkSession.createDataFrame([], f"{id_column} {kind}, raw double")
    q = np.asarray(query, float)
    q = q / max(np.linalg.norm(q), TINY)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            m = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(m) != len(q) * batch.num_rows:
                raise ValueError(f"vectors of {len(q)} numbers are needed")
            m = m.reshape(batch.num_rows, len(q))
            raw = (m @ q) / np.maximum(np.sqrt((m * m).sum(1)), TINY)
            keep = np.arange(len(raw))
            if k < len(raw):
                bar = np.partition(raw, len(raw) - k)[len(raw) - k]
                keep = np.flatnonzero(raw >= bar - 1e-11)  # ids decide between ties
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(raw[keep])], names=[id_column, "raw"])

    return points.select(id_column, as_double(F.col(signal))).mapInArrow(run, f"{id_column} {kind}, raw double")


def vector_of(points: DataFrame, point_id: int, signal: str) -> list[float] | None:
    row = points.where(F.col("point_id") == point_id).select(signal).first()
    return None if row is None or row[0] is None else list(row[0])


def batch_knn(points: DataFrame, signal: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    """query_id, point_id, rank, similarity: the k nearest of every query, itself included."""
    as_rows = lambda df: df.where(F.col(signal).isNotNull()).select(F.col("point_id").alias("id"), F.col(signal).alias("vector"))
    return nearest(as_rows(points if queries is None else queries), as_rows(points), k).withColumnRenamed("id", "point_id")


def fusion_search(points: DataFrame, reid: list[float], face: list[float] | None, k: int = 5, per_signal: int = TOP_K_PER_SIGNAL, consistent: bool = False) -> DataFrame:
    """Weighted rank fusion of the two signals' hits.

    A candidate that only the body signal found, and that has a face, gets its face similarity times
    the face weight; ``consistent`` gives the last rank's score instead. Similarities are in 4
    decimals; face_status tells how the face counted.
    """
    hits = candidates(points, reid, face, per_signal)
    q = F.array(*[F.lit(float(x)) for x in face]) if face is not None else F.lit(None).cast("array<double>")
    own = points.select("point_id", F.col("face").alias("own_face"), "original_image", "crop_path")
    rows = hits.join(own, "point_id")
    direct = F.when(F.col("face_rank").isNull() & F.col("reid_rank").isNotNull(), cosine(F.col("own_face"), q))
    rows = rows.withColumn("direct", direct)
    zero = F.lit(0.0)
    late = F.when(F.col("direct").isNotNull(), linear_rank_score(F.lit(per_signal), per_signal)) if consistent else F.col("direct")
    score = (
        F.coalesce(linear_rank_score(F.col("reid_rank"), per_signal) * REID_WEIGHT, zero)
        + F.coalesce(linear_rank_score(F.col("face_rank"), per_signal) * FACE_WEIGHT, zero)
        + F.coalesce(late * FACE_WEIGHT, zero)
    )
    status = (
        F.when(F.col("face_rank").isNotNull(), "ranked")
        .when(F.col("direct").isNotNull(), "direct")
        .when(F.lit(face is None), "query_no_face")
        .otherwise("person_no_face")
    )
    order = [F.desc(F.round("score", 12)), F.asc_nulls_last("reid_rank"), F.asc_nulls_last("face_rank")]
    best = rows.withColumn("score", score).withColumn("face_status", status).orderBy(*order).limit(k)
    return best.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        "point_id",
        F.round("score", 4).alias("fusion_score"),
        F.round("reid_raw", 4).alias("reid_similarity"),
        F.round(F.coalesce("face_raw", "direct"), 4).alias("face_similarity"),
        "face_status",
        "original_image",
        "crop_path",
    )


def candidates(points: DataFrame, reid: list[float], face: list[float] | None, per_signal: int = TOP_K_PER_SIGNAL) -> DataFrame:
    """point_id, reid_rank, reid_raw, face_rank, face_raw: union of both signals' hits."""
    a = top_k(points, reid, "reid", per_signal).select("point_id", F.col("rank").alias("reid_rank"), F.col("raw").alias("reid_raw"))
    b = top_k(points, face, "face", per_signal).select("point_id", F.col("rank").alias("face_rank"), F.col("raw").alias("face_raw"))
    return a.join(b, "point_id", "full_outer")


def candidate_sets(points: DataFrame, reid: list[float], face: list[float] | None, per_signal: int = TOP_K_PER_SIGNAL) -> DataFrame:
    """point_id and membership: both, reid_only or face_only."""
    found = candidates(points, reid, face, per_signal)
    member = F.when(F.col("face_rank").isNull(), "reid_only").when(F.col("reid_rank").isNull(), "face_only").otherwise("both")
    return found.select("point_id", member.alias("membership"))


def rank1_detail(points: DataFrame, k: int = 20, queries: DataFrame | None = None) -> DataFrame:
    """query_id, point_id, similarity, is_hit: the first of the k nearest that is allowed.

    The query itself and the same person seen by the same camera are dropped after the cut at k, so
    a query can be left without an answer; it is then not in the result.
    """
    who = points.select("point_id", "market_id", "camera_id")
    near = batch_knn(points, "reid", k, queries)
    rows = near.join(who.select(F.col("point_id").alias("query_id"), F.col("market_id").alias("q_market"), F.col("camera_id").alias("q_camera")), "query_id").join(who, "point_id")
    allowed = (F.col("point_id") != F.col("query_id")) & ~((F.col("market_id") == F.col("q_market")) & (F.col("camera_id") == F.col("q_camera")))
    first = rows.where(allowed).groupBy("query_id").agg(F.min_by(F.struct("point_id", "similarity", (F.col("market_id") == F.col("q_market")).alias("is_hit")), "rank").alias("best"))
    return first.select("query_id", "best.point_id", F.round("best.similarity", 4).alias("similarity"), "best.is_hit")


def rank1_accuracy(detail: DataFrame) -> DataFrame:
    """evaluated, correct, accuracy (0 without evaluated queries)."""
    n, ok = F.count("*"), F.count_if("is_hit")
    return detail.agg(n.alias("evaluated"), ok.alias("correct"), F.round(F.coalesce(F.try_divide(ok, n), F.lit(0.0)), 6).alias("accuracy"))
