"""Whole runs: build a points table from images, answer a search as JSON, cluster and compare."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import base_name, stable_point_id
from ..operators import clustering, documents, ingest, metrics, search
from ..sources.files import images
from ..storage import stored, tidy


def build_points(
    spark: SparkSession, folder: str, path: str, load_detector, load_encoder, dimension: int, source: str, reset: bool = False,
    load_face=None, face_threshold: float = 0.5,
) -> DataFrame:
    """Detect, crop and encode the images of a folder, write the points, return the counters.

    Ids are hashes of the crop names, so a repeated run writes the same points, and they are those that
    search and clustering take. With ``load_face`` each crop's best face is the second signal.
    """
    found = stored(ingest.expand_images(images(spark, folder), load_detector), "crops")
    named = found.where("status = 'ok'").withColumn("crop_name", F.concat(base_name(F.col("path")), F.lit("_person_"), F.col("crop_no").cast("string"), F.lit(".jpg")))
    encoded = ingest.encode_images(named.select(F.col("crop_name").alias("path"), F.col("crop").alias("content")), load_encoder, dimension)
    vectors = stored(encoded, "vectors")
    if load_face:
        faces = ingest.detect_faces(named.select(F.col("crop_name").alias("path"), F.col("crop").alias("content")), load_face, face_threshold)
    else:
        faces = spark.createDataFrame([], ingest.FACES)
    faces = stored(ingest.best_face(faces, "path", face_threshold).withColumnRenamed("path", "crop_name"), "faces")
    rows = named.join(vectors.where("status = 'ok'").select(F.col("path").alias("crop_name"), "vector"), "crop_name")
    points = rows.join(faces, "crop_name", "left").select(
        stable_point_id(F.col("crop_name")).alias("point_id"), F.col("vector").alias("reid"), F.col("embedding").alias("face"), F.lit(source).alias("source"),
        F.col("path").alias("original_image"), F.col("crop_name").alias("crop_path"), F.col("crop_name").alias("crop_filename"), F.lit(True).alias("person_detection"),
        F.col("embedding").isNotNull().alias("face_detected"), F.col("det_score").alias("face_detection_score"), F.col("bbox").alias("face_bbox"),
        F.col("age").alias("face_age"), F.col("gender").alias("face_gender"),
    )
    ingest.write_points(points, path, reset, "reid", dimension)
    good = vectors.where("status = 'ok'").select(F.col("path").alias("crop_name"))
    per_image = found.join(named.select("path", "crop_no", "crop_name"), ["path", "crop_no"], "left").join(good.withColumn("encoded", F.lit(1)), "crop_name", "left")
    per_image = per_image.join(faces.select("crop_name", F.lit(1).alias("with_face")), "crop_name", "left")
    outcome = per_image.groupBy("path").agg(
        F.when(F.count_if(F.col("status") == "failed") > 0, "failed").when(F.count_if(F.col("status") == "ok") == 0, "no_person").when(F.count("encoded") == 0, "failed").otherwise("ok").alias("status"),
        F.count("encoded").alias("persons"), F.count_if(F.col("encoded").isNotNull() & F.col("with_face").isNotNull()).alias("faces"),
    )
    return ingest.etl_counters(outcome)


def search_document(points: DataFrame, query_id: int, k: int = 10, query_type: str = "person") -> DataFrame:
    """One row of JSON: the k hits of a stored point's vector in their envelope."""
    began = time.time()
    hits = search.top_k(points, search.vector_of(points, query_id, "reid"), "reid", k)
    ids = documents.first_embedding_ids(points.select("crop_path", F.col("point_id").alias("ordinal")))
    rows = hits.join(points.select("point_id", "original_image", "crop_path", "crop_filename", "dataset", "camera_id"), "point_id").join(ids, "crop_path")
    found = stored(documents.search_result(rows, query_type), "hits")
    return documents.result_envelope(found, str(query_id), query_type, k, (time.time() - began) * 1000)


def cluster_all(points: DataFrame, methods: dict[str, dict], folder: str) -> DataFrame:
    """Run the methods (name: parameters with ``method``), save labels, documents and summaries, compare.

    Each method's tables are written as soon as it is done, so a broken run keeps what it has.
    """
    who = metrics.ground_truth(points)
    out = None
    for name, parameters in methods.items():
        began = time.time()
        labels = stored(clustering.cluster(points, **parameters), "labels")
        seconds = time.time() - began
        labels.write.mode("overwrite").parquet(f"{folder}/{name}/labels")
        documents.cluster_document(documents.cluster_members(labels, points)).write.mode("overwrite").json(f"{folder}/{name}/clusters")
        documents.cluster_summary(labels, name).write.mode("overwrite").json(f"{folder}/{name}/summary")
        row = stored(metrics.evaluate(labels.join(who, "point_id")).select(F.lit(name).alias("algorithm"), "*", F.round(F.lit(seconds), 3).alias("time_seconds")), "quality")
        ingest.save_experiment(row.drop("algorithm"), f"{folder}/experiments", name)
        out = row if out is None else out.unionByName(row)
        tidy(points.sparkSession)
    return out


def ranked_experiments(results: DataFrame) -> DataFrame:
    """Experiments by ari, then nmi, then purity, best first."""
    return results.orderBy(F.desc("ari"), F.desc("nmi"), F.desc("purity"))
