"""Cluster and result documents: members, summaries, result JSON, flattening, key search."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import reciprocal_rank_score

MEMBER_FIELDS = ("point_id", "market_id", "camera_id", "source", "dataset", "split", "original_image", "filename")
CLUSTER_DOCUMENT = "map<string, string>"


def cluster_members(labels: DataFrame, points: DataFrame) -> DataFrame:
    """cluster_id and its member rows, one row each (fields that a point lacks are null)."""
    have = [F.col(c) if c in points.columns else F.lit(None).cast("string").alias(c) for c in MEMBER_FIELDS]
    return labels.select("point_id", "cluster_id").join(points.select(*have), "point_id").select("cluster_id", *MEMBER_FIELDS)


def cluster_document(members: DataFrame) -> DataFrame:
    """cluster_id, size, members: one JSON array for each cluster, ordered by point_id.

    One row per cluster, so a document of all clusters is written as JSON lines, not gathered.
    """
    each = F.sort_array(F.collect_list(F.struct(*MEMBER_FIELDS)))
    return members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.to_json(each, {"ignoreNullFields": "false"}).alias("members"))


def cluster_summary(labels: DataFrame, algorithm: str) -> DataFrame:
    """algorithm, total_points, cluster_count, noise_count and cluster_sizes (label:size of all labels)."""
    s = labels.groupBy("cluster_id").agg(F.count("*").alias("size"))
    sizes = F.sort_array(F.collect_list(F.struct("cluster_id", "size")))
    listed = F.array_join(F.transform(sizes, lambda x: F.concat_ws(":", x["cluster_id"].cast("string"), x["size"].cast("string"))), ",")
    return s.agg(
        F.lit(algorithm).alias("algorithm"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_points"),
        F.count_if(F.col("cluster_id") != -1).alias("cluster_count"),
        F.coalesce(F.sum(F.when(F.col("cluster_id") == -1, F.col("size"))), F.lit(0)).alias("noise_count"),
        listed.alias("cluster_sizes"),
    )


def sizes_map(labels: DataFrame) -> DataFrame:
    """cluster_sizes as a map of label text to size."""
    s = labels.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return s.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("cluster_id").cast("string"), "size")))).alias("cluster_sizes"))


def find_key(document: Column, key: str) -> Column:
    """First int under ``key`` at any depth: of an object itself, then within its payload, then within its other values.

    Lists are not searched. A value that Python's ``int`` or an int column does not take is passed over.
    """

    def find(text):
        try:
            todo = [json.loads(text)]
        except (TypeError, ValueError):
            return None
        while todo:
            held = todo.pop()
            if not isinstance(held, dict):
                continue
            try:
                found = int(held[key])
                if -(1 << 31) <= found < 1 << 31:
                    return found
            except (KeyError, TypeError, ValueError, OverflowError):
                pass
            todo.extend(v for k, v in reversed(held.items()) if k != "payload")
            todo.append(held.get("payload"))
        return None

    @F.pandas_udf("int")
    def find_all(texts: pd.Series) -> pd.Series:
        return pd.Series([find(t) for t in texts], dtype="Int32")

    return find_all(document)


def flatten_cluster_document(documents: DataFrame, column: str = "document", key: str = "market_id") -> DataFrame:
    """cluster_id and market_id of each member of a cluster document; market_id is null where missing.

    Labels that are not integers and values that are not lists are skipped.
    """
    entries = documents.select(F.explode(F.from_json(column, CLUSTER_DOCUMENT)).alias("label", "value"))
    lists = entries.where(F.col("label").try_cast("int").isNotNull() & F.trim("value").startswith("["))
    members = lists.select(F.col("label").try_cast("int").alias("cluster_id"), F.explode(F.from_json("value", "array<string>")).alias("member"))
    return members.select("cluster_id", find_key(F.col("member"), key).alias(key))


def search_result(hits: DataFrame, query_type: str = "person") -> DataFrame:
    """The fields of one search hit; hits have rank, point_id, embedding_id, similarity and the point's columns."""
    score = reciprocal_rank_score(F.col("rank"))
    return hits.select(
        "rank", "embedding_id", F.lit("image").alias("result_type"), F.lit(query_type + "_image").alias("source_type"), "similarity",
        score.alias("rank_score"), F.col("similarity").alias("raw_score"), F.col("similarity").alias("fusion_score"),
        "original_image", "crop_path", F.col("crop_filename").alias("crop_name"), "dataset", F.lit("test").alias("split"),
        F.lit(0).alias("video_id"), F.lit(0).alias("video_frame"), F.lit(0).alias("video_time"), "camera_id",
    )


def result_envelope(hits: DataFrame, query: str, query_type: str, top_k: int, time_ms: float) -> DataFrame:
    """One row of JSON: the envelope of a search and its top hits in rank order."""
    rows = F.sort_array(F.collect_list(F.struct(*hits.columns)))
    return hits.agg(F.to_json(F.struct(
        F.lit(query).alias("query"), F.lit(query_type).alias("query_type"), F.lit("image").alias("result_type"), F.lit("test").alias("split"),
        F.lit(top_k).alias("top_k"), F.count("*").alias("result_count"), F.round(F.lit(time_ms), 3).alias("search_time_ms"),
        F.max("similarity").alias("best_similarity"), F.lit("exact").alias("search_mode"), rows.alias("results"),
    ), {"ignoreNullFields": "false"}).alias("document"))


def first_embedding_ids(metadata: DataFrame) -> DataFrame:
    """crop_path, embedding_id: the first ordinal of each path."""
    return metadata.groupBy("crop_path").agg(F.min("ordinal").alias("embedding_id"))


def report(title: str, rows: DataFrame, n: int = 20) -> str:
    """A titled text table of the first n rows, as the console reports show them; it is printed too."""
    text = f"{'=' * 60}\n{title}\n{'=' * 60}\n{rows._jdf.showString(n, 0, False)}"
    print(text)
    return text


def metric_or(row: DataFrame, key: str, default: float = 0.0) -> Column:
    """A metric of a result row: its own column, else the one of its ``evaluation`` struct, else the default."""
    own = [F.col(key)] if key in row.columns else []
    nested = [F.col(f"evaluation.{key}")] if "evaluation" in row.columns and key in row.schema["evaluation"].dataType.names else []
    return F.coalesce(*own, *nested, F.lit(default))
