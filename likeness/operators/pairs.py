"""Blocked pairwise kernels: every point against every point without a nested-loop join.

Both sides are cut into blocks of bounded size. While the smaller side's proven size (rows times
dimension) is at most ``BROADCAST_BYTES`` it is broadcast as one matrix; beyond it each pair of
blocks of at most about ``BLOCK_BYTES`` is one task, which holds no more than these two, and each side is
sent only once for every block of the other. Within a table each two blocks meet once. Neighbours within a
distance are found in one pass, so a table of over ``ONE_PASS_BYTES`` goes by blocks, past the driver;
searches that go over the same vectors in many rounds broadcast more.
A kernel gets ``STEP_ROWS`` by ``STEP_CANDIDATES`` vectors at a time (32 MB of products), and its rows
leave the task after each such step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

BROADCAST_BYTES = 64 << 20
ONE_PASS_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 2048
STEP_ROWS, STEP_CANDIDATES = 256, 16_384

#: (query ids, query matrix, candidate ids, candidate matrix) -> rows
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column], float).reshape(len(column), -1 if len(column) else 1)


def packed(rows: DataFrame, scale: Callable[[np.ndarray], np.ndarray] = unit_rows) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and scaled vectors of the rows, which come to the driver as bytes, not as lists of numbers."""

    def pack(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"ids": [frame["id"].to_numpy(np.int64).tobytes()], "vectors": [scale(_matrix(frame["vector"])).tobytes()]})

    found = rows.select("id", "vector").mapInPandas(pack, "ids binary, vectors binary").collect()
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    ids = np.concatenate([np.frombuffer(r[0], np.int64) for r in found])
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    matrix, at = None, 0
    for r in found:
        n = len(r[0]) // 8
        part = np.frombuffer(r[1]).reshape(n, -1)
        matrix = np.empty((len(ids), part.shape[1])) if matrix is None else matrix
        matrix[place[at : at + n]] = part
        at += n
    return ids[order], matrix


def _steps(kernel: Kernel, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray) -> Iterator[pd.DataFrame]:
    for i in range(0, len(q), STEP_ROWS):
        for j in range(0, len(c), STEP_CANDIDATES):
            yield kernel(q_ids[i : i + STEP_ROWS], q[i : i + STEP_ROWS], c_ids[j : j + STEP_CANDIDATES], c[j : j + STEP_CANDIDATES])


def pairwise(queries: DataFrame, candidates: DataFrame, kernel: Kernel, schema: str, unit: bool = True, once: bool = False, most: int | None = None) -> DataFrame:
    """Apply ``kernel`` to blocks of (id, vector) queries and all blocks of (id, vector) candidates.

    With ``once`` both sides are one table, whose blocks are sent to each other once for both orders.
    ``most`` may lower ``BROADCAST_BYTES``. A caller that has stored the rows may ``release`` the matrix.
    """
    spark = queries.sparkSession
    ship(spark)
    size = candidates.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    scale = unit_rows if unit else (lambda m: m)
    parallelism = max(2, spark.sparkContext.defaultParallelism)
    if size["n"] * max(1, size["d"] or 1) * 8 <= min(BROADCAST_BYTES, BROADCAST_BYTES if most is None else most):
        shared = spark.sparkContext.broadcast(packed(candidates, scale))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c_ids, c = shared.value
            for frame in frames:
                for at in range(0, len(frame), BLOCK_ROWS):
                    part = frame.iloc[at : at + BLOCK_ROWS]
                    yield from _steps(kernel, part["id"].to_numpy(np.int64), scale(_matrix(part["vector"])), c_ids, c)

        spread = queries.select("id", "vector").repartition(parallelism, "id")
        found = spread.mapInPandas(run, schema)
        found._likeness_shared = shared
        return found
    rows_of_block = max(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, size["d"] or 1)))
    enough = math.ceil(math.sqrt((6 if once else 3) * parallelism))  # blocks, for three tasks a core
    blocks = lambda n: max(n // rows_of_block + 1, min(enough, n // BLOCK_ROWS + 1))
    n_c = blocks(size["n"])
    n_q = n_c if once else blocks(queries.count())
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    others = lambda first, n: F.explode(F.sequence(first, F.lit(n - 1)))
    left = queries.select("id", "vector", block(n_q).alias("q"), F.lit(0).alias("side"))
    left = left.withColumn("c", others(F.col("q") if once else F.lit(0), n_c))
    right = candidates.select("id", "vector", block(n_c).alias("c"), F.lit(1).alias("side"))
    right = right.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("c"))) if once else others(F.lit(0), n_q))
    both = left.select("q", "c", "side", "id", "vector").unionByName(right.select("q", "c", "side", "id", "vector"))
    # each pair of blocks has a number, and its task the same one, so none waits behind another
    number = F.expr("c * (c + 1) div 2 + q" if once else f"q * {n_c} + c").cast("int")
    dealt = both.repartitionById(n_c * (n_c + 1) // 2 if once else n_q * n_c, number)

    def pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, parts, same = ([], []), ([], []), False
        for frame in frames:
            same |= bool(len(frame)) and frame["q"].iat[0] == frame["c"].iat[0]
            for side in range(2):
                rows = frame[frame["side"] == side]
                if len(rows):
                    ids[side].append(rows["id"].to_numpy(np.int64))
                    parts[side].append(scale(_matrix(rows["vector"])))
        if not ids[0] or not ids[1]:
            yield kernel(*[np.zeros(0, np.int64), np.zeros((0, 1))] * 2)
            return
        sides = []
        for side in range(2):
            all_ids, matrix = np.concatenate(ids[side]), np.concatenate(parts[side])
            parts[side].clear()
            order = np.argsort(all_ids, kind="stable")  # as the broadcast matrix is, so that kernels may settle ties by place
            sides.append((all_ids[order], matrix[order]))
        del matrix
        yield from _steps(kernel, *sides[0], *sides[1])
        if once and not same:
            yield from _steps(kernel, *sides[1], *sides[0])

    return dealt.mapInPandas(pair, schema)


def release(found: DataFrame) -> None:
    """Delete the broadcast matrix of ``found``, if there is one, when nothing will compute these rows again."""
    shared = getattr(found, "_likeness_shared", None)
    if shared is not None:
        shared.destroy()


def nearest(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, id, similarity of the k most similar candidates of each query, ties by id; with rank."""
    from pyspark.sql import Window

    def kernel(q_ids, q, c_ids, c):
        if not len(q_ids) or not len(c_ids):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        s = q @ c.T
        keep = min(k, s.shape[1])
        # all that tie with the k-th stay, so that ids decide exactly
        bar = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep][:, None]
        row, col = np.nonzero(s >= bar - 1e-12)
        return pd.DataFrame({"query_id": q_ids[row], "id": c_ids[col], "similarity": s[row, col]})

    found = pairwise(queries, candidates, kernel, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    ranked._likeness_shared = getattr(found, "_likeness_shared", None)
    return ranked


def within_distance(rows: DataFrame, eps: float) -> DataFrame:
    """i, j, distance of all pairs i < j whose cosine distance is at most eps."""

    def kernel(q_ids, q, c_ids, c):
        d = q @ c.T if len(q_ids) and len(c_ids) else np.zeros((len(q_ids), len(c_ids)))
        np.subtract(1, d, out=d)
        row, col = np.nonzero((d <= eps) & (q_ids[:, None] < c_ids[None, :]))
        return pd.DataFrame({"i": q_ids[row], "j": c_ids[col], "distance": d[row, col]})

    return pairwise(rows, rows, kernel, "i long, j long, distance double", once=True, most=ONE_PASS_BYTES)
