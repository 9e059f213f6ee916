"""Cluster statistics and quality from labels: purity, adjusted Rand, mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISE = -1


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster_id").agg(F.count("*").alias("size"))


def cluster_stats(labels: DataFrame, include_noise: bool = False) -> DataFrame:
    """One row: points, clusters, noise, ratio, size extremes and mean, identities (if market_id is there)."""
    s = cluster_sizes(labels)
    counted = F.lit(True) if include_noise else F.col("cluster_id") != NOISE
    size = F.when(counted, F.col("size"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    total, noise = zero(F.sum("size")), zero(F.sum(F.when(F.col("cluster_id") == NOISE, F.col("size"))))
    out = s.agg(
        total.alias("total_points"), F.count(size).alias("cluster_count"), noise.alias("noise_count"), (total - noise).alias("clustered_count"),
        F.round(F.coalesce(F.try_divide(noise, total), F.lit(0.0)), 6).alias("noise_ratio"),
        zero(F.min(size)).alias("min_size"), zero(F.max(size)).alias("max_size"), F.round(F.coalesce(F.avg(size), F.lit(0.0)), 6).alias("avg_size"),
    )
    if "market_id" in labels.columns:
        out = out.crossJoin(labels.agg(F.countDistinct("market_id").alias("identities")))  # one row each
    return out


def top_clusters(labels: DataFrame, n: int = 20, by_size: bool = True) -> DataFrame:
    """The n largest clusters (noise left out, ties by label), or the first n labels."""
    s = cluster_sizes(labels)
    return s.where(F.col("cluster_id") != NOISE).orderBy(F.desc("size"), "cluster_id").limit(n) if by_size else s.orderBy("cluster_id").limit(n)


def ground_truth(points: DataFrame) -> DataFrame:
    """point_id, market_id (int); reading raises where a point has no identity."""
    given = points["market_id"] if "market_id" in points.columns else F.lit(None)
    missing = F.raise_error(F.lit("a point has no market_id")).cast("int")
    return points.select("point_id", F.when(given.isNotNull(), given.cast("int")).otherwise(missing).alias("market_id"))


def contingency(labels: DataFrame) -> DataFrame:
    """market_id, cluster_id, n."""
    return labels.groupBy("market_id", "cluster_id").agg(F.count("*").alias("n"))


def purity(labels: DataFrame, include_noise: bool = False) -> DataFrame:
    """One row: the majority share over the clusters; 0 without points. Noise counts as a cluster if included."""
    rows = labels if include_noise else labels.where(F.col("cluster_id") != NOISE)
    c = contingency(rows).groupBy("cluster_id").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return c.agg(F.round(F.coalesce(F.try_divide(F.sum("most"), F.sum("all")), F.lit(0.0)), 6).alias("purity"))


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def ari(labels: DataFrame) -> DataFrame:
    """One row: adjusted Rand index (Hubert and Arabie 1985); noise is a cluster like others; 1 if trivial."""
    t = contingency(labels)
    s = t.agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    a = t.groupBy("market_id").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("a"))
    b = t.groupBy("cluster_id").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("b"))
    one = s.crossJoin(a).crossJoin(b)  # one row each
    expected = F.coalesce(F.try_divide(F.col("a") * F.col("b"), _pairs(F.col("total"))), F.lit(0.0))
    top, bottom = F.col("s") - expected, (F.col("a") + F.col("b")) / 2 - expected
    value = F.when(F.coalesce(F.abs(bottom), F.lit(0.0)) < 1e-12, 1.0).otherwise(F.try_divide(top, bottom))
    return one.select(F.round(F.coalesce(value, F.lit(1.0)), 6).alias("ari"))


def nmi(labels: DataFrame) -> DataFrame:
    """One row: mutual information over the mean of both entropies; 1 if both are 0."""
    t = contingency(labels)
    total = t.agg(F.sum("n").cast("double").alias("total"))
    a = t.groupBy("market_id").agg(F.sum("n").alias("a"))
    b = t.groupBy("cluster_id").agg(F.sum("n").alias("b"))

    def entropy(side: DataFrame, n: str, name: str) -> DataFrame:
        p = F.col(n) / F.col("total")
        return side.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.ln(p))).alias(name))

    joint = t.join(a, "market_id").join(b, "cluster_id").crossJoin(F.broadcast(total))
    n = F.col("n").cast("double")
    mi = joint.agg(F.sum(n / F.col("total") * F.ln(F.col("total") * n / (F.col("a").cast("double") * F.col("b")))).alias("mi"))
    one = mi.crossJoin(entropy(a, "a", "ha")).crossJoin(entropy(b, "b", "hb"))  # one row each
    mean = (F.col("ha") + F.col("hb")) / 2
    return one.select(F.round(F.when(F.coalesce(mean, F.lit(0.0)) < 1e-12, 1.0).otherwise(F.col("mi") / mean), 6).alias("nmi"))


def evaluate(labels: DataFrame, valid_only: bool = True) -> DataFrame:
    """One row: statistics, purity, ari, nmi; only points of known identity (> 0) count if ``valid_only``."""
    rows = labels.where(F.col("market_id") > 0) if valid_only else labels
    return cluster_stats(rows.drop("market_id")).crossJoin(purity(rows)).crossJoin(ari(rows)).crossJoin(nmi(rows))


def quality_by(rows: DataFrame, by: str = "experiment") -> DataFrame:
    """``by``, purity (noise left out), ari, nmi of the labels of many experiments, in one pass for all."""
    t = rows.groupBy(by, "market_id", "cluster_id").agg(F.count("*").alias("n"))
    within = t.where(F.col("cluster_id") != NOISE).groupBy(by, "cluster_id").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    pure = within.groupBy(by).agg((F.sum("most") / F.sum("all")).alias("purity"))
    joint = t.groupBy(by).agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").cast("double").alias("total"))

    def side(name: str, n: str) -> tuple[DataFrame, DataFrame]:
        sums = t.groupBy(by, name).agg(F.sum("n").alias(n))
        total = F.sum(n).cast("double")
        # the entropy of counts that sum to t is ln t - sum(n ln n) / t
        entropy = F.ln(total) - F.sum(F.col(n) * F.ln(n)) / total
        return sums, sums.groupBy(by).agg(F.sum(_pairs(F.col(n))).alias(f"p{n}"), entropy.alias(f"h{n}"))

    (a, of_a), (b, of_b) = side("market_id", "a"), side("cluster_id", "b")
    shared = t.join(a, [by, "market_id"]).join(b, [by, "cluster_id"]).join(joint, by)
    n = F.col("n").cast("double")
    mi = shared.groupBy(by).agg(F.sum(n / F.col("total") * F.ln(F.col("total") * n / (F.col("a").cast("double") * F.col("b")))).alias("mi"))
    one = joint.join(of_a, by).join(of_b, by).join(mi, by).join(pure, by, "left")
    expected = F.coalesce(F.try_divide(F.col("pa") * F.col("pb"), _pairs(F.col("total"))), F.lit(0.0))
    bottom, mean = (F.col("pa") + F.col("pb")) / 2 - expected, (F.col("ha") + F.col("hb")) / 2
    rand = F.when(F.abs(bottom) < 1e-12, 1.0).otherwise(F.try_divide(F.col("s") - expected, bottom))
    mutual = F.when(mean < 1e-12, 1.0).otherwise(F.try_divide(F.col("mi"), mean))
    return one.select(by, F.round(F.coalesce("purity", F.lit(0.0)), 6).alias("purity"), F.round(rand, 6).alias("ari"), F.round(mutual, 6).alias("nmi"))


def best_experiments(results: DataFrame) -> DataFrame:
    """metric, experiment, value: the best experiment by each metric, the first of equals."""
    out = None
    for metric in ("ari", "nmi", "purity"):
        best = results.agg(F.max_by(F.struct("experiment", metric), F.struct(F.col(metric), -F.col("experiment"))).alias("b"))
        row = best.select(F.lit(metric).alias("metric"), "b.experiment", F.col(f"b.{metric}").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def latency_stats(runs: DataFrame, group: str, value: str, baseline=None) -> DataFrame:
    """mean, upper median (the middle value, the higher of two), min and max of each group.

    With ``baseline``, a value of the group, also the speed-up: the baseline's mean over the group's.
    """
    middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
    out = runs.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count("*").alias("runs"), F.avg(value).alias("mean"), F.round(middle, 6).alias("median"), F.round(F.min(value), 6).alias("min"), F.round(F.max(value), 6).alias("max")
    )
    if baseline is None:
        return out.withColumn("mean", F.round("mean", 6))
    base = out.where(F.col(group) == baseline).select(F.col("mean").alias("base"))
    rows = out.crossJoin(F.broadcast(base))  # one row
    return rows.withColumn("speed_up", F.round(F.try_divide(F.col("base"), F.col("mean")), 6)).withColumn("mean", F.round("mean", 6)).drop("base")


def resolution_study(runs: DataFrame, persons: DataFrame, baseline: int) -> DataFrame:
    """resolution, mean latency, persons a run, mean confidence (0 without persons) and speed-up over the baseline.

    ``runs`` has resolution, run and ms, ``persons`` a row of resolution and confidence for each person found.
    """
    times = runs.groupBy("resolution").agg(F.count("*").alias("runs"), F.avg("ms").alias("mean"))
    seen = persons.groupBy("resolution").agg(F.count("*").alias("persons"), F.avg("confidence").alias("confidence"))
    rows = times.join(seen, "resolution", "left")
    base = times.where(F.col("resolution") == baseline).select(F.col("mean").alias("base"))
    return rows.crossJoin(F.broadcast(base)).select(  # one row
        "resolution", "runs", F.round("mean", 6).alias("mean_ms"), F.round(F.coalesce("persons", F.lit(0)) / F.col("runs"), 6).alias("persons"),
        F.round(F.coalesce("confidence", F.lit(0.0)), 6).alias("confidence"), F.round(F.try_divide(F.col("base"), F.col("mean")), 6).alias("speed_up"),
    )
