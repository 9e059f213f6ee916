"""Every registered query with the SQL that checks it.

The SQL reads the plain test tables, so it repeats the adapters of ``sources.points`` as common table
expressions. Similarities are compared in 4 or 6 decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, names, vectors
from ..operators import clustering, documents, ingest, metrics, search
from ..sources import files
from ..sources.points import FACE_DIMENSION, REID_DIMENSION, detections, points, table
from ..sources.points import vectors as signal_vectors
from ..storage import stored, tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERY_POINT, EPS, MIN_SAMPLES = 1, 0.65, 3
#: Nine radii, as many as the original grid has, in the range that the test vectors need.
SWEEP = [(round(0.60 + 0.01 * n, 2), 3) for n in range(9)]

POINTS = """points AS (
  SELECT vec_id AS point_id, embedding::DOUBLE[] AS reid,
    CASE WHEN vec_id % 5 <> 0 THEN (embedding::DOUBLE[])[1:32] END AS face,
    CASE WHEN vec_id % 10 < 9 THEN 'market1501' ELSE 'sample_photos' END AS source,
    'photos/img_' || (vec_id // 4) || '.jpg' AS original_image,
    printf('%04d_c%ds%d_%06d_00.jpg', label, vec_id % 6 + 1, vec_id % 3 + 1, vec_id) AS filename,
    CAST(label AS INTEGER) AS market_id, CAST(vec_id % 6 AS INTEGER) AS camera_id
  FROM embeddings),
units AS (
  SELECT point_id, market_id, camera_id, list_transform(reid, lambda x: x / greatest(sqrt(list_dot_product(reid, reid)), 1e-12)) AS u FROM points)"""

DETECTIONS = """detections AS (
  SELECT event_id AS detection_id, event_id // 8 AS image_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'person' ELSE event_type END AS class_name,
    (event_id * 17 % 100) / 100.0::DOUBLE AS confidence,
    (event_id * 37 % 720 - 60)::DOUBLE AS x1, (event_id * 53 % 560 - 60)::DOUBLE AS y1,
    (event_id * 37 % 720 - 60 + 40 + event_id * 29 % 260)::DOUBLE AS x2,
    (event_id * 53 % 560 - 60 + 60 + event_id * 31 % 300)::DOUBLE AS y2
  FROM events),
clamped AS (
  SELECT detection_id, image_id, class_name, confidence,
    CAST(least(greatest(trunc(x1), 0), 640) AS INTEGER) AS x1, CAST(least(greatest(trunc(y1), 0), 480) AS INTEGER) AS y1,
    CAST(least(greatest(trunc(x2), 0), 640) AS INTEGER) AS x2, CAST(least(greatest(trunc(y2), 0), 480) AS INTEGER) AS y2
  FROM detections)"""


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


# -- scans --------------------------------------------------------------------------------------


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vec_scan(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    total = F.aggregate(vectors.as_double(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.size("embedding").alias("dimension"), F.round(total, 6).alias("total"))


@query(f"WITH {POINTS} SELECT point_id, source, market_id FROM points WHERE source = 'market1501' AND len(reid) = 64")
def vec_scan_reid(spark, sf_dir):
    return signal_vectors(points(spark, sf_dir), "reid", REID_DIMENSION, "market1501").select("point_id", "source", "market_id")


@query(f"WITH {POINTS} SELECT point_id, round(list_sum(face), 6) AS total FROM points WHERE len(face) = 32")
def vec_scan_face(spark, sf_dir):
    total = F.aggregate("face", F.lit(0.0), lambda s, x: s + x)
    return signal_vectors(points(spark, sf_dir), "face", FACE_DIMENSION).select("point_id", F.round(total, 6).alias("total"))


@query(
    f"WITH {POINTS} SELECT 'persons' AS collection, count(*) AS points_count, count(reid) AS reid_count, "
    "count(face) AS face_count, count(DISTINCT source) AS source_count FROM points"
)
def collection_stats(spark, sf_dir):
    return files.collection_stats(points(spark, sf_dir), "persons")


IMAGES = [f"photos/img_{n}.jpg" for n in (0, 3, 10, 40)]


@query(
    f"WITH {POINTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY original_image ORDER BY point_id) AS n FROM points "
    f"WHERE original_image IN {tuple(IMAGES)}) SELECT original_image, point_id, face IS NOT NULL AS face_detected FROM ranked WHERE n <= 10"
)
def diag_face_lookup(spark, sf_dir):
    rows = points(spark, sf_dir).where(F.col("original_image").isin(IMAGES)).select("original_image", "point_id", "face_detected")
    return ingest.first_per_group(rows, "original_image", "point_id", 10)


# -- names and boxes ----------------------------------------------------------------------------


@query(
    f"WITH {POINTS} SELECT filename, CAST(regexp_extract(filename, '^(-?\\d+)_c(\\d)s\\d', 1) AS INTEGER) AS person_id, "
    "CAST(regexp_extract(filename, '^(-?\\d+)_c(\\d)s\\d', 2) AS INTEGER) - 1 AS camera_id FROM points "
    "WHERE CAST(regexp_extract(filename, '^(-?\\d+)_c(\\d)s\\d', 1) AS INTEGER) > 0"
)
def market_parse(spark, sf_dir):
    f = F.col("filename")
    rows = points(spark, sf_dir).select(f, names.person_of(f).alias("person_id"), names.camera_of(f).alias("camera_id"))
    return rows.where(F.col("person_id").isNotNull())


@query(
    f"WITH {POINTS} SELECT count(*) AS found, CAST(count_if(market_id > 0) AS BIGINT) AS kept, CAST(count_if(market_id <= 0) AS BIGINT) AS skipped FROM points"
)
def market_skip_stats(spark, sf_dir):
    person = names.person_of(F.col("filename"))
    return points(spark, sf_dir).agg(F.count("*").alias("found"), F.count(person).alias("kept"), F.count_if(person.isNull()).alias("skipped"))


@query(f"WITH {POINTS} SELECT filename, camera_id, camera_id + 1 AS camera_label FROM points")
def camera_parse(spark, sf_dir):
    f = F.col("filename")
    return points(spark, sf_dir).select(f, names.camera_anywhere(f).alias("camera_id"), names.camera_label(f).alias("camera_label"))


@query(
    "SELECT page_id, list_last(string_split(url, '/')) AS base_name, "
    "regexp_replace(list_last(string_split(url, '/')), '(.)\\.[^.]*$', '\\1') AS stem, "
    "CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS relative, sha256(url) AS stable_id FROM pages"
)
def path_funcs(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", names.base_name(u).alias("base_name"), names.stem(u).alias("stem"), names.relative_to(u, F.lit("https:/")).alias("relative"), names.stable_id(u).alias("stable_id")
    )


@query(f"WITH {DETECTIONS} SELECT detection_id, x1, y1, x2, y2 FROM clamped WHERE x2 > x1 AND y2 > y1 AND x2 - x1 >= 90 AND y2 - y1 >= 120")
def bbox_clamp(spark, sf_dir):
    d = boxes.clamped(detections(spark, sf_dir), F.lit(640), F.lit(480))
    return d.where(boxes.not_empty() & boxes.large_enough()).select("detection_id", "x1", "y1", "x2", "y2")


@query(f"WITH {DETECTIONS} SELECT detection_id, round((x2 - x1) * (y2 - y1) / (640 * 480) * 100, 6) AS area_percent FROM detections WHERE class_name = 'person' AND confidence >= 0.3")
def bbox_area_pct(spark, sf_dir):
    small = boxes.persons(detections(spark, sf_dir), boxes.SMALL_CONFIDENCE)
    return small.select("detection_id", F.round(boxes.area_percent(F.lit(640), F.lit(480)), 6).alias("area_percent"))


@query(f"WITH {DETECTIONS} SELECT detection_id, image_id, confidence FROM detections WHERE class_name = 'person' AND confidence >= 0.5")
def detect_filter(spark, sf_dir):
    return boxes.persons(detections(spark, sf_dir)).select("detection_id", "image_id", "confidence")


@query(
    f"WITH {DETECTIONS}, kept AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY detection_id) AS n FROM clamped "
    "WHERE class_name = 'person' AND confidence >= 0.5 AND x2 - x1 >= 90 AND y2 - y1 >= 120) "
    "SELECT detection_id, image_id || '_person_' || n || '.jpg' AS crop_name FROM kept"
)
def crop_naming(spark, sf_dir):
    d = boxes.clamped(boxes.persons(detections(spark, sf_dir)), F.lit(640), F.lit(480)).where(boxes.not_empty() & boxes.large_enough())
    return boxes.with_crop_names(d, "image_id", "detection_id").select("detection_id", "crop_name")


@query(
    f"WITH {DETECTIONS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, detection_id) AS n FROM detections "
    "WHERE confidence >= 0.5) SELECT image_id, detection_id AS face_no, confidence AS det_score FROM ranked WHERE n = 1"
)
def face_best(spark, sf_dir):
    faces = detections(spark, sf_dir).select("image_id", F.col("detection_id").alias("face_no"), F.col("confidence").alias("det_score"))
    return ingest.best_face(faces, "image_id", 0.5)


# -- vectors and search -------------------------------------------------------------------------


@query(f"WITH {POINTS} SELECT point_id, round(u[1], 6) AS first_value, round(list_sum(u), 6) AS total, round(sqrt(list_dot_product(u, u)), 6) AS length FROM units")
def l2_normalize(spark, sf_dir):
    rows = points(spark, sf_dir).select("point_id", vectors.l2_normalize(F.col("reid")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x)
    return rows.select("point_id", F.round(F.get("u", F.lit(0)), 6).alias("first_value"), F.round(total, 6).alias("total"), F.round(vectors.norm(F.col("u")), 6).alias("length"))


@query(
    f"WITH {POINTS} SELECT a.filename, round(list_cosine_similarity(a.reid, b.reid), 6) AS similarity "
    "FROM points a JOIN points b ON b.point_id = a.point_id + 1"
)
def cosine_pair(spark, sf_dir):
    """Two versions of a vector by file name: here each point's and its successor's."""
    p = points(spark, sf_dir)
    first = p.select("point_id", "filename", "reid")
    second = p.select((F.col("point_id") - 1).alias("point_id"), F.col("reid").alias("other"))
    return first.join(second, "point_id").select("filename", F.round(vectors.cosine(F.col("reid"), F.col("other")), 6).alias("similarity"))


def _top(signal: str, k: int, where: str = "true") -> str:
    return (
        f"WITH {POINTS}, q AS (SELECT {signal} AS v FROM points WHERE point_id = {QUERY_POINT}), s AS ("
        f"SELECT point_id, list_cosine_similarity({signal}, (SELECT v FROM q)) AS raw FROM points WHERE {signal} IS NOT NULL AND {where}) "
        f"SELECT point_id, CAST(row_number() OVER (ORDER BY raw DESC, point_id) AS INTEGER) AS rank, round(raw, 4) AS similarity FROM s ORDER BY raw DESC, point_id LIMIT {k}"
    )


def _search(spark, sf_dir, signal, k):
    p = points(spark, sf_dir)
    return search.top_k(p, search.vector_of(p, QUERY_POINT, signal), signal, k).select("point_id", "rank", "similarity")


@query(_top("reid", 3))
def knn_topk(spark, sf_dir):
    return _search(spark, sf_dir, "reid", 3)


@query(_top("reid", 5))
def search_reid(spark, sf_dir):
    return _search(spark, sf_dir, "reid", 5)


@query(_top("face", 5))
def search_face(spark, sf_dir):
    return _search(spark, sf_dir, "face", 5)


NEAR = """sims AS (
  SELECT a.point_id AS query_id, b.point_id, list_dot_product(a.u, b.u) AS s FROM units a, units b),
near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, point_id) AS rank FROM sims)"""


@query(f"WITH {POINTS}, {NEAR} SELECT query_id, point_id, CAST(rank AS INTEGER) AS rank, round(s, 4) AS similarity FROM near WHERE rank <= 20")
def knn_batch(spark, sf_dir):
    near = search.batch_knn(points(spark, sf_dir), "reid", 20)
    return near.select("query_id", "point_id", "rank", F.round("similarity", 4).alias("similarity"))


RANK1 = f"""WITH {POINTS}, {NEAR}, allowed AS (
  SELECT n.query_id, n.point_id, n.s, p.market_id = q.market_id AS is_hit, row_number() OVER (PARTITION BY n.query_id ORDER BY n.rank) AS k
  FROM near n JOIN points q ON q.point_id = n.query_id JOIN points p ON p.point_id = n.point_id
  WHERE n.rank <= 20 AND n.query_id <> n.point_id AND NOT (p.market_id = q.market_id AND p.camera_id = q.camera_id)),
detail AS (SELECT query_id, point_id, round(s, 4) AS similarity, is_hit FROM allowed WHERE k = 1)"""


@query(f"{RANK1} SELECT * FROM detail")
def rank1_detail(spark, sf_dir):
    return search.rank1_detail(points(spark, sf_dir))


@query(f"{RANK1} SELECT count(*) AS evaluated, CAST(count_if(is_hit) AS BIGINT) AS correct, round(coalesce(count_if(is_hit) / count(*), 0), 6) AS accuracy FROM detail")
def rank1_accuracy(spark, sf_dir):
    return search.rank1_accuracy(search.rank1_detail(points(spark, sf_dir)))


FUSED = f"""WITH {POINTS}, q AS (SELECT reid, face FROM points WHERE point_id = {QUERY_POINT}),
r AS (SELECT point_id, s, row_number() OVER (ORDER BY s DESC, point_id) AS k FROM (SELECT point_id, list_cosine_similarity(reid, (SELECT reid FROM q)) AS s FROM points) ORDER BY s DESC, point_id LIMIT 50),
f AS (SELECT point_id, s, row_number() OVER (ORDER BY s DESC, point_id) AS k FROM (SELECT point_id, list_cosine_similarity(face, (SELECT face FROM q)) AS s FROM points WHERE face IS NOT NULL) ORDER BY s DESC, point_id LIMIT 50),
both_hits AS (SELECT coalesce(r.point_id, f.point_id) AS point_id, r.k AS rk, r.s AS rs, f.k AS fk, f.s AS fs FROM r FULL OUTER JOIN f ON r.point_id = f.point_id)"""


@query(f"{FUSED} SELECT point_id, CASE WHEN fk IS NULL THEN 'reid_only' WHEN rk IS NULL THEN 'face_only' ELSE 'both' END AS membership FROM both_hits")
def fusion_candidates(spark, sf_dir):
    p = points(spark, sf_dir)
    return search.candidate_sets(p, search.vector_of(p, QUERY_POINT, "reid"), search.vector_of(p, QUERY_POINT, "face"))


@query(
    f"""{FUSED}, scored AS (
  SELECT h.*, p.original_image, 'crops/' || p.filename AS crop_path, CASE WHEN fk IS NULL THEN o.s END AS direct
  FROM both_hits h JOIN points p USING (point_id)
  LEFT JOIN (SELECT point_id, list_cosine_similarity(face, (SELECT face FROM q)) AS s FROM points WHERE face IS NOT NULL) o USING (point_id)),
totals AS (
  SELECT *, coalesce(0.6 * (51 - rk) / 50.0::DOUBLE, 0) + coalesce(0.4 * (51 - fk) / 50.0::DOUBLE, 0) + coalesce(0.4 * direct, 0) AS score FROM scored)
SELECT CAST(row_number() OVER (ORDER BY round(score, 12) DESC, rk NULLS LAST, fk NULLS LAST) AS INTEGER) AS rank, point_id, round(score, 4) AS fusion_score,
  round(rs, 4) AS reid_similarity, round(coalesce(fs, direct), 4) AS face_similarity,
  CASE WHEN fk IS NOT NULL THEN 'ranked' WHEN direct IS NOT NULL THEN 'direct' ELSE 'person_no_face' END AS face_status, original_image, crop_path
FROM totals ORDER BY round(score, 12) DESC, rk NULLS LAST, fk NULLS LAST LIMIT 10"""
)
def fusion_search(spark, sf_dir):
    p = points(spark, sf_dir)
    return search.fusion_search(p, search.vector_of(p, QUERY_POINT, "reid"), search.vector_of(p, QUERY_POINT, "face"), k=10)


@query(f"WITH {POINTS} SELECT 'crops/' || filename AS crop_path, min(point_id) AS embedding_id FROM points GROUP BY filename")
def embedding_id_lookup(spark, sf_dir):
    return documents.first_embedding_ids(points(spark, sf_dir).select("crop_path", F.col("point_id").alias("ordinal")))


@query(
    f"WITH {POINTS}, q AS (SELECT reid FROM points WHERE point_id = {QUERY_POINT}), hits AS (SELECT point_id, list_cosine_similarity(reid, (SELECT reid FROM q)) AS raw, original_image, filename, camera_id FROM points ORDER BY raw DESC, point_id LIMIT 10), "
    "ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY raw DESC, point_id) AS INTEGER) AS rank FROM hits) "
    "SELECT rank, point_id AS embedding_id, 'image' AS result_type, 'person_image' AS source_type, round(raw, 4) AS similarity, round(1.0::DOUBLE / rank, 4) AS rank_score, "
    "round(raw, 4) AS raw_score, round(raw, 4) AS fusion_score, original_image, 'crops/' || filename AS crop_path, filename AS crop_name, 'market1501' AS dataset, 'test' AS split, "
    "0 AS video_id, 0 AS video_frame, 0 AS video_time, camera_id FROM ranked"
)
def search_result_json(spark, sf_dir):
    p = points(spark, sf_dir)
    hits = search.top_k(p, search.vector_of(p, QUERY_POINT, "reid"), "reid", 10)
    ids = documents.first_embedding_ids(p.select("crop_path", F.col("point_id").alias("ordinal")))
    rows = hits.join(p.select("point_id", "original_image", "crop_path", "crop_filename", "dataset", "camera_id"), "point_id").join(ids, "crop_path")
    return documents.search_result(rows)


# -- clustering ---------------------------------------------------------------------------------


def _edges(eps: float) -> str:
    return f"SELECT a.point_id AS i, b.point_id AS j, 1 - list_dot_product(a.u, b.u) AS distance FROM units a JOIN units b ON a.point_id < b.point_id WHERE 1 - list_dot_product(a.u, b.u) <= {eps}"


@query(f"WITH {POINTS}, e AS ({_edges(EPS)}) SELECT i, j, round(distance, 6) AS distance FROM e")
def eps_neighbors(spark, sf_dir):
    return clustering.eps_neighbors(points(spark, sf_dir), EPS).select("i", "j", F.round("distance", 6).alias("distance"))


def _dbscan(eps: float, m: int, n: str = "") -> str:
    """Common table expressions whose last, labels{n}, has point_id and cluster_id."""
    return f"""e{n} AS ({_edges(eps)}),
b{n} AS (SELECT i, j FROM e{n} UNION ALL SELECT j, i FROM e{n}),
core{n} AS (SELECT p.point_id AS id FROM points p LEFT JOIN b{n} ON b{n}.i = p.point_id GROUP BY p.point_id HAVING count(b{n}.j) + 1 >= {m}),
reach{n}(id, root) AS (
  SELECT id, id FROM core{n}
  UNION
  SELECT b{n}.j, r.root FROM reach{n} r JOIN b{n} ON b{n}.i = r.id JOIN core{n} c ON c.id = b{n}.j),
root{n} AS (SELECT id, min(root) AS root FROM reach{n} GROUP BY id),
num{n} AS (SELECT id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS c FROM root{n}),
border{n} AS (SELECT b{n}.i AS id, min(num{n}.c) AS c FROM b{n} JOIN num{n} ON num{n}.id = b{n}.j WHERE b{n}.i NOT IN (SELECT id FROM core{n}) GROUP BY b{n}.i),
labels{n} AS (SELECT p.point_id, p.market_id, coalesce(k.c, -1) AS cluster_id FROM points p LEFT JOIN (SELECT * FROM num{n} UNION ALL SELECT * FROM border{n}) k ON k.id = p.point_id)"""


LABELS = f"WITH RECURSIVE {POINTS}, {_dbscan(EPS, MIN_SAMPLES)}"


def _labels(spark, sf_dir):
    """DBSCAN labels with the identities."""
    p = points(spark, sf_dir)
    return clustering.dbscan(p, EPS, MIN_SAMPLES).join(p.select("point_id", "market_id"), "point_id")


@query(f"{LABELS} SELECT point_id, cluster_id FROM labels")
def dbscan(spark, sf_dir):
    return clustering.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES)


@query(
    f"WITH RECURSIVE {POINTS}, " + ", ".join(_dbscan(e, m, str(n)) for n, (e, m) in enumerate(SWEEP)) + " "
    + " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS experiment, {e}::DOUBLE AS eps, CAST({m} AS INTEGER) AS min_samples, point_id, cluster_id FROM labels{n}" for n, (e, m) in enumerate(SWEEP))
)
def dbscan_sweep(spark, sf_dir):
    return clustering.dbscan_sweep(points(spark, sf_dir), [e for e, _ in SWEEP], MIN_SAMPLES)


K, ROUNDS = 8, 3


def _lloyd() -> str:
    steps = [f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY point_id) - 1 AS INTEGER) AS c, u AS v FROM units ORDER BY point_id LIMIT {K})"]
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS (SELECT point_id, u, c FROM (SELECT point_id, u, c, row_number() OVER (PARTITION BY point_id ORDER BY round(list_dot_product(u, u) - 2 * list_dot_product(u, v) + list_dot_product(v, v), 12), c) AS k FROM units, c{r}) WHERE k = 1)"
        )
        if r < ROUNDS:
            steps.append(
                f"m{r} AS (SELECT c, list(m ORDER BY d) AS v FROM (SELECT c, d, avg(x) AS m FROM (SELECT c, unnest(u) AS x, unnest(range(len(u))) AS d FROM a{r}) GROUP BY c, d) GROUP BY c)"
            )
            steps.append(f"c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON m{r}.c = c{r}.c)")
    return f"WITH {POINTS}, " + ", ".join(steps) + f" SELECT point_id, c AS cluster_id FROM a{ROUNDS}"


@query(_lloyd())
def kmeans_lloyd(spark, sf_dir):
    return clustering.kmeans_lloyd(points(spark, sf_dir), K, ROUNDS)


@query()
def kmeans_ml(spark, sf_dir):
    return clustering.kmeans_ml(points(spark, sf_dir), 100)


@query(f"WITH {POINTS}, {NEAR} SELECT query_id AS point_id, round(1 - min(s), 6) AS core_distance FROM near WHERE rank <= 5 GROUP BY query_id")
def core_distance(spark, sf_dir):
    return clustering.core_distance(points(spark, sf_dir), 5).select("point_id", F.round("core_distance", 6).alias("core_distance"))


@query(
    f"WITH {POINTS}, {NEAR}, core AS (SELECT query_id AS id, 1 - min(s) AS d FROM near WHERE rank <= 5 GROUP BY query_id), "
    "pairs AS (SELECT least(query_id, point_id) AS i, greatest(query_id, point_id) AS j, min(1 - s) AS d FROM near WHERE rank <= 5 AND query_id <> point_id GROUP BY 1, 2) "
    "SELECT i, j, round(greatest(pairs.d, a.d, b.d), 6) AS distance FROM pairs JOIN core a ON a.id = i JOIN core b ON b.id = j"
)
def mutual_reachability(spark, sf_dir):
    return clustering.mutual_reachability(points(spark, sf_dir), 5).select("i", "j", F.round("distance", 6).alias("distance"))


@query()
def hdbscan(spark, sf_dir):
    return clustering.hdbscan(points(spark, sf_dir), 5, 5)


@query()
def hdbscan_sweep(spark, sf_dir):
    return clustering.hdbscan_sweep(points(spark, sf_dir), [5, 10, 20, 30, 50], [5, 10, 20])


@query()
def agglomerative(spark, sf_dir):
    return clustering.agglomerative(points(spark, sf_dir), [100], "average")


@query()
def agglo_sweep(spark, sf_dir):
    return clustering.agglomerative_sweep(points(spark, sf_dir), [50, 75, 100, 125, 150, 175, 200])


# -- statistics and documents -------------------------------------------------------------------


@query(f"{LABELS} SELECT cluster_id, count(*) AS size FROM labels GROUP BY cluster_id")
def cluster_sizes(spark, sf_dir):
    return metrics.cluster_sizes(_labels(spark, sf_dir))


STATS = (
    "CAST(sum(size) AS BIGINT) AS total_points, CAST(count_if(cluster_id <> -1) AS BIGINT) AS cluster_count, CAST(coalesce(sum(size) FILTER (WHERE cluster_id = -1), 0) AS BIGINT) AS noise_count, "
    "CAST(coalesce(sum(size) FILTER (WHERE cluster_id <> -1), 0) AS BIGINT) AS clustered_count, round(coalesce(sum(size) FILTER (WHERE cluster_id = -1), 0) / sum(size), 6) AS noise_ratio, "
    "coalesce(min(size) FILTER (WHERE cluster_id <> -1), 0) AS min_size, coalesce(max(size) FILTER (WHERE cluster_id <> -1), 0) AS max_size, round(coalesce(avg(size) FILTER (WHERE cluster_id <> -1), 0), 6) AS avg_size"
)


@query(f"{LABELS}, s AS (SELECT cluster_id, count(*) AS size FROM labels GROUP BY cluster_id) SELECT {STATS}, (SELECT count(DISTINCT market_id) FROM labels) AS identities FROM s")
def cluster_stats(spark, sf_dir):
    return metrics.cluster_stats(_labels(spark, sf_dir))


@query(f"{LABELS} SELECT cluster_id, count(*) AS size FROM labels WHERE cluster_id <> -1 GROUP BY cluster_id ORDER BY size DESC, cluster_id LIMIT 20")
def top_clusters(spark, sf_dir):
    return metrics.top_clusters(_labels(spark, sf_dir))


PURITY = "SELECT round(coalesce(sum(m) / sum(n), 0), 6) AS purity FROM (SELECT max(n) AS m, sum(n) AS n FROM (SELECT cluster_id, market_id, count(*) AS n FROM {0} GROUP BY 1, 2) GROUP BY cluster_id)"


@query(f"{LABELS}, kept AS (SELECT * FROM labels WHERE cluster_id <> -1) {PURITY.format('kept')}")
def purity(spark, sf_dir):
    return metrics.purity(_labels(spark, sf_dir))


@query(f"{LABELS} {PURITY.format('labels')}")
def purity_all(spark, sf_dir):
    return metrics.purity(_labels(spark, sf_dir), include_noise=True)


def _ari(source: str) -> str:
    return (
        f"SELECT round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM "
        f"(SELECT sum(x * (x - 1) / 2) AS s, sum(x) AS n FROM (SELECT count(*)::DOUBLE AS x FROM {source} GROUP BY market_id, cluster_id)), "
        f"(SELECT sum(x * (x - 1) / 2) AS a FROM (SELECT count(*)::DOUBLE AS x FROM {source} GROUP BY market_id)), "
        f"(SELECT sum(x * (x - 1) / 2) AS b FROM (SELECT count(*)::DOUBLE AS x FROM {source} GROUP BY cluster_id))"
    )


def _nmi(source: str) -> str:
    return (
        f"SELECT round(mi / ((ha + hb) / 2), 6) AS nmi FROM "
        f"(SELECT sum(n / t * ln(t * n / (a * b))) AS mi FROM (SELECT DISTINCT market_id, cluster_id, count(*) OVER (PARTITION BY market_id, cluster_id)::DOUBLE AS n, "
        f"count(*) OVER (PARTITION BY market_id)::DOUBLE AS a, count(*) OVER (PARTITION BY cluster_id)::DOUBLE AS b, count(*) OVER ()::DOUBLE AS t FROM {source})), "
        f"(SELECT -sum(p * ln(p)) AS ha FROM (SELECT count(*) / (SELECT count(*)::DOUBLE FROM {source}) AS p FROM {source} GROUP BY market_id)), "
        f"(SELECT -sum(p * ln(p)) AS hb FROM (SELECT count(*) / (SELECT count(*)::DOUBLE FROM {source}) AS p FROM {source} GROUP BY cluster_id))"
    )


@query(f"{LABELS} {_ari('labels')}")
def ari(spark, sf_dir):
    return metrics.ari(_labels(spark, sf_dir))


@query(f"{LABELS} {_nmi('labels')}")
def nmi(spark, sf_dir):
    return metrics.nmi(_labels(spark, sf_dir))


@query(
    f"{LABELS}, s AS (SELECT cluster_id, count(*) AS size FROM labels GROUP BY cluster_id) SELECT 'dbscan' AS algorithm, CAST(sum(size) AS BIGINT) AS total_points, "
    "CAST(count_if(cluster_id <> -1) AS BIGINT) AS cluster_count, CAST(coalesce(sum(size) FILTER (WHERE cluster_id = -1), 0) AS BIGINT) AS noise_count, "
    "string_agg(cluster_id || ':' || size, ',' ORDER BY cluster_id) AS cluster_sizes FROM s"
)
def cluster_summary(spark, sf_dir):
    return documents.cluster_summary(_labels(spark, sf_dir), "dbscan")


@query(
    f"{LABELS} SELECT l.cluster_id, p.point_id, p.market_id, p.camera_id, p.source, 'market1501' AS dataset, 'test' AS split, p.original_image, p.filename "
    "FROM labels l JOIN points p USING (point_id)"
)
def cluster_members(spark, sf_dir):
    p = points(spark, sf_dir)
    return documents.cluster_members(clustering.dbscan(p, EPS, MIN_SAMPLES), p)


def _experiments(spark, sf_dir):
    p = points(spark, sf_dir).select("point_id", "market_id")
    return metrics.quality_by(stored(dbscan_sweep(spark, sf_dir), "sweep").join(p, "point_id"))


def experiments_sql(select: str) -> str:
    """``select`` from r, the quality of each experiment of the sweep."""
    ctes = ", ".join(_dbscan(e, m, str(n)) for n, (e, m) in enumerate(SWEEP))
    kept = ", ".join(f"kept{n} AS (SELECT * FROM labels{n} WHERE cluster_id <> -1)" for n in range(len(SWEEP)))
    rows = " UNION ALL ".join(
        f"SELECT CAST({n} AS INTEGER) AS experiment, ({PURITY.format(f'kept{n}')}) AS purity, ({_ari(f'labels{n}')}) AS ari, ({_nmi(f'labels{n}')}) AS nmi" for n in range(len(SWEEP))
    )
    return f"WITH RECURSIVE {POINTS}, {ctes}, {kept}, r AS ({rows}) {select}"


def _best_sql() -> str:
    return experiments_sql(" UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS metric, experiment, {m} AS value FROM r ORDER BY {m} DESC, experiment LIMIT 1)" for m in ("ari", "nmi", "purity")))


@query(_best_sql())
def tuning_best(spark, sf_dir):
    return metrics.best_experiments(_experiments(spark, sf_dir))


def _compare_sql() -> str:
    lloyd = _lloyd()
    steps = lloyd[lloyd.index("c0 AS") : lloyd.rindex(" SELECT point_id, c AS")]
    sources = {"dbscan": "valid_d", "kmeans": "valid_k"}
    head = (
        f"{LABELS}, {steps}, valid_d AS (SELECT * FROM labels WHERE market_id > 0), "
        f"valid_k AS (SELECT a.point_id, p.market_id, a.c AS cluster_id FROM a{ROUNDS} a JOIN points p USING (point_id) WHERE p.market_id > 0)"
    )
    rows = []
    for name, s in sources.items():
        rows.append(
            f"SELECT '{name}' AS algorithm, st.*, p.purity, x.ari, y.nmi FROM (SELECT {STATS} FROM (SELECT cluster_id, count(*) AS size FROM {s} GROUP BY cluster_id)) st, "
            f"({PURITY.format(f'(SELECT * FROM {s} WHERE cluster_id <> -1)')}) p, ({_ari(s)}) x, ({_nmi(s)}) y"
        )
    return f"{head} " + " UNION ALL ".join(rows)


@query(_compare_sql())
def cluster_compare(spark, sf_dir):
    """Statistics and quality of the algorithms side by side, over points of known identity."""
    p = points(spark, sf_dir)
    who = p.select("point_id", "market_id")
    out = None
    for name, labels in (("dbscan", clustering.dbscan(p, EPS, MIN_SAMPLES)), ("kmeans", clustering.kmeans_lloyd(p, K, ROUNDS))):
        row = stored(metrics.evaluate(labels.join(who, "point_id")).withColumn("algorithm", F.lit(name)), "quality")
        out = row if out is None else out.unionByName(row)
        tidy(spark)
    return out


@query()
def cluster_compare_all(spark, sf_dir):
    """All four families side by side; two of them are beyond SQL."""
    p = points(spark, sf_dir)
    who = metrics.ground_truth(p)
    methods = {
        "kmeans": {"method": "kmeans", "k": K, "rounds": ROUNDS}, "dbscan": {"method": "dbscan", "eps": EPS, "min_samples": MIN_SAMPLES},
        "hdbscan": {"method": "hdbscan", "min_cluster_size": 5, "min_samples": 5}, "agglomerative": {"method": "agglomerative", "n_clusters": 100, "linkage": "average"},
    }
    out = None
    for name, parameters in methods.items():
        labels = stored(clustering.cluster(p, **parameters).join(who, "point_id"), "labels")
        row = stored(metrics.evaluate(labels).withColumn("algorithm", F.lit(name)), "quality")  # not all at once
        out = row if out is None else out.unionByName(row)
        tidy(spark)
    return out


@query("SELECT CAST(doc_id % 50 AS INTEGER) AS cluster_id, CASE WHEN doc_id % 7 <> 0 THEN CAST(n_chars AS INTEGER) END AS market_id FROM documents WHERE doc_id % 50 <> 13")
def cluster_doc_flatten(spark, sf_dir):
    """Cluster documents made of the documents table; one label is not an integer, some members lack an id."""
    d = table(spark, sf_dir, "documents")
    label = F.when(F.col("doc_id") % 50 == 13, F.lit("thirteen")).otherwise((F.col("doc_id") % 50).cast("string"))
    member = F.to_json(F.when(F.col("doc_id") % 7 != 0, F.struct(F.col("n_chars").alias("market_id"))).otherwise(F.struct(F.lit(None).cast("long").alias("market_id"))))
    whole = d.groupBy(label.alias("label")).agg(F.collect_list(member).alias("members"))
    document = F.concat(F.lit('{"'), F.col("label"), F.lit('": ['), F.array_join("members", ","), F.lit("]}"))
    return documents.flatten_cluster_document(whole.select(document.alias("document")))


@query(
    "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE CAST(page_id * 3 AS INTEGER) END AS market_id FROM pages"
)
def json_find_key(spark, sf_dir):
    """The key at the top, in the payload, deeper, or as a text that is no number."""
    i, n = F.col("page_id"), (F.col("page_id") * 3).cast("string")
    document = (
        F.when(i % 4 == 0, F.concat(F.lit('{"market_id": '), n, F.lit("}")))
        .when(i % 8 == 5, F.concat(F.lit('{"a": {"b": 1}, "payload": {"x": {"y": {"market_id": '), n, F.lit("}}}}")))
        .when(i % 8 == 6, F.concat(F.lit('{"a": {"b": {"market_id": '), n, F.lit('}}, "c": {"market_id": 1}}')))
        .when(i % 4 == 1, F.concat(F.lit('{"payload": {"market_id": "'), n, F.lit('"}}')))
        .when(i % 4 == 2, F.concat(F.lit('{"a": [1], "extra": {"market_id": '), n, F.lit("}}")))
        .otherwise(F.lit('{"market_id": "unknown", "other": 5}'))
    )
    return table(spark, sf_dir, "pages").select("page_id", documents.find_key(document, "market_id").alias("market_id"))


@query(
    f"WITH {POINTS} SELECT point_id, CASE WHEN point_id % 3 = 0 THEN 'updated' WHEN point_id % 3 = 2 THEN 'second' ELSE source END AS source FROM points "
    "UNION ALL SELECT point_id + 1000000, 'inserted' FROM points WHERE point_id % 3 = 1"
)
def upsert_merge(spark, sf_dir):
    old = points(spark, sf_dir).select("point_id", "source")
    changed = old.where("point_id % 3 = 0").select("point_id", F.lit("updated").alias("source"), F.lit(2).alias("version"))
    stale = old.where("point_id % 3 = 0").select("point_id", F.lit("stale").alias("source"), F.lit(1).alias("version"))
    added = old.where("point_id % 3 = 1").select((F.col("point_id") + 1000000).alias("point_id"), F.lit("inserted").alias("source"), F.lit(1).alias("version"))
    # equal keys of equal version: the last one wins
    twice = old.where("point_id % 3 = 2").select("point_id", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("source"), F.lit(1).alias("version"))
    return ingest.upsert(old, stale.unionByName(changed).unionByName(added).unionByName(twice), "point_id", "version")


@query(f"WITH {POINTS} SELECT camera_id, filename FROM (SELECT camera_id, filename, row_number() OVER (PARTITION BY camera_id ORDER BY filename) AS n FROM points) WHERE n <= 3")
def sample_per_camera(spark, sf_dir):
    return ingest.first_per_group(points(spark, sf_dir).select("camera_id", "filename"), "camera_id", "filename", 3)


@query(
    f"WITH {POINTS} SELECT filename, market_id FROM (SELECT filename, market_id FROM points ORDER BY md5('42:' || filename), filename LIMIT 2000) WHERE market_id > 0"
)
def sample_then_filter(spark, sf_dir):
    rows = points(spark, sf_dir).select("filename", "market_id")
    return ingest.sample_then_filter(rows, "filename", 2000, F.col("market_id") > 0)


@query(
    "SELECT count(*) AS found, CAST(count_if(n_chars >= 100 AND doc_id % 11 <> 0) AS BIGINT) AS processed, CAST(count_if(doc_id % 11 = 0) AS BIGINT) AS failed, "
    "CAST(count_if(n_chars < 100 AND doc_id % 11 <> 0) AS BIGINT) AS no_person, CAST(sum(doc_id % 4) AS BIGINT) AS persons, CAST(sum(doc_id % 2) AS BIGINT) AS faces FROM documents"
)
def etl_counters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 11 == 0, "failed").when(F.col("n_chars") < 100, "no_person").otherwise("ok")
    return ingest.etl_counters(d.select(status.alias("status"), (F.col("doc_id") % 4).alias("persons"), (F.col("doc_id") % 2).alias("faces")))


@query(
    "SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, round(max(CASE WHEN k = n // 2 + 1 THEN value END), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max "
    "FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type"
)
def latency_stats(spark, sf_dir):
    return metrics.latency_stats(table(spark, sf_dir, "events"), "event_type", "value")


@query(
    "WITH s AS (SELECT event_type, count(*) AS runs, avg(value) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type), "
    "m AS (SELECT event_type, max(CASE WHEN k = n // 2 + 1 THEN value END) AS median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, "
    "count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type) "
    "SELECT event_type, runs, round(mean, 6) AS mean, round(median, 6) AS median, min, max, round((SELECT mean FROM s WHERE event_type = 'view') / mean, 6) AS speed_up FROM s JOIN m USING (event_type)"
)
def latency_speed_up(spark, sf_dir):
    """Latency of each kind, and how much faster than the baseline kind it is on average."""
    return metrics.latency_stats(table(spark, sf_dir, "events"), "event_type", "value", baseline="view")


@query(
    f"WITH {DETECTIONS}, runs AS (SELECT CAST(576 - 64 * (event_id % 4) AS INTEGER) AS resolution, avg(value) AS mean, count(*) AS runs FROM events WHERE value IS NOT NULL GROUP BY 1), "
    "seen AS (SELECT CAST(576 - 64 * (detection_id % 4) AS INTEGER) AS resolution, count(*) AS n, avg(confidence) AS c FROM detections WHERE class_name = 'person' AND confidence >= 0.5 GROUP BY 1) "
    "SELECT resolution, runs, round(mean, 6) AS mean_ms, round(coalesce(n, 0) / runs, 6) AS persons, round(coalesce(c, 0), 6) AS confidence, "
    "round((SELECT mean FROM runs WHERE resolution = 576) / mean, 6) AS speed_up FROM runs LEFT JOIN seen USING (resolution)"
)
def resolution_study(spark, sf_dir):
    """Four input resolutions: latency, persons found, confidence and speed-up over the largest."""
    of = lambda i: (576 - 64 * (F.col(i) % 4)).cast("int").alias("resolution")
    runs = table(spark, sf_dir, "events").where("value IS NOT NULL").select(of("event_id"), F.col("value").alias("ms"))
    seen = boxes.persons(detections(spark, sf_dir)).select(of("detection_id"), "confidence")
    return metrics.resolution_study(runs, seen, 576)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused search over both signals."""
    return fusion_search(spark, sf_dir)
