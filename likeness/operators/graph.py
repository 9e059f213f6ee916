"""Connected components and global numbering, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop_stored, ease, stored


#: Up to this many edges one task finds the components; the count is checked each time.
SMALL_EDGES = 500_000


def components(edges: DataFrame, a: str, b: str, small: int = SMALL_EDGES) -> DataFrame:
    """vertex, component (its smallest vertex) of all vertices of ``edges``.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every step is an aggregation
    and a join on the vertex; the edges of a hub, in the end all of a component's, are one join key, which
    adaptive execution splits. The number of steps grows with the logarithm of the longest chain. A few
    edges (``small`` at most) are joined in one task instead.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    if small and now.count() <= small:
        return _in_one_task(now)
    while True:
        # large star: each vertex links its larger neighbours to its smallest
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that both sides of the join are plain exchanges and a hub's edges can be split over tasks
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # small star: each vertex links its smaller neighbours and itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = stored(linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        same = _digest(now) == _digest(small)
        for table in (least, large, now):
            drop_stored(table)
        now = small
        ease(edges.sparkSession)
        if same:
            break
    roots = now.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def join(frame):
        import pandas as pd

        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for u, v in zip(frame["u"], frame["v"], strict=True):
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
        vertices = list(parent)
        return pd.DataFrame({"vertex": vertices, "component": [root(v) for v in vertices]})

    return edges.groupBy(F.lit(1).alias("one")).applyInPandas(join, f"vertex {kind}, component {kind}")


def _digest(edges: DataFrame) -> tuple:
    """Number and two independent hashes of a set of distinct edges; exclusive or cannot overflow, as a sum of hashes does."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit("edge"), "u")).alias("y")).first()
    return tuple(row)


def numbered(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys with their place in ascending order from 0, without one task for all.

    Keys are dealt by range; only the parts' counts (one row a task) pass through the driver.
    """
    spark = keys.sparkSession
    parts = stored(keys.select(key).distinct().repartitionByRange(key).withColumn("part", F.spark_partition_id()), "numbered")
    base, offsets = 0, []
    for row in sorted(parts.groupBy("part").count().collect()):
        offsets.append((row["part"], base))
        base += row["count"]
    before = F.broadcast(spark.createDataFrame(offsets, "part int, base long"))
    n = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return parts.withColumn("n", n).join(before, "part").select(key, (F.col("base") + F.col("n")).cast("int").alias(name))
