import pytest
from pyspark.sql import functions as F

from likeness.functions import boxes, names, vectors


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_normalise_zero_and_unit(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.l2_normalize(zero)) == [0.0, 0.0]
    assert one(spark, vectors.l2_normalize_guarded(zero)) == [0.0, 0.0]
    assert one(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]


def test_cosine_of_zero_is_null(spark):
    a, zero = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, zero)) is None
    assert one(spark, vectors.cosine_distance(a, a)) == 0.0


def test_dimension_filter_and_check(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, v array<double>")
    assert [r.id for r in rows.where(vectors.has_dimension(F.col("v"), 2)).collect()] == [1]
    with pytest.raises(Exception, match="2 numbers"):
        rows.select(vectors.require_dimension(F.col("v"), 2)).collect()


@pytest.mark.parametrize(
    "name,person,camera",
    [("0002_c1s1_000451_03.jpg", 2, 0), ("-1_c3s2_000001_00.jpg", None, None), ("0000_c2s1_000001_00.jpg", None, None), ("readme.txt", None, None), ("x_0002_c1s1_0.jpg", None, None)],
)
def test_gallery_names(spark, name, person, camera):
    assert one(spark, names.person_of(F.lit(name))) == person
    assert one(spark, names.camera_of(F.lit(name))) == camera


def test_cameras_anywhere(spark):
    assert one(spark, names.camera_anywhere(F.lit("x_0002_c4s1_0.jpg"))) == 3
    assert one(spark, names.camera_label(F.lit("x_0002_c4s1_0.jpg"))) == 4
    assert one(spark, names.camera_label(F.lit("none.jpg"))) is None


def test_paths(spark):
    path = F.lit("/data/a/b.tar.gz")
    assert one(spark, names.base_name(path)) == "b.tar.gz"
    assert one(spark, names.stem(path)) == "b.tar"
    assert one(spark, names.relative_to(path, F.lit("/data"))) == "a/b.tar.gz"
    assert one(spark, names.is_image(F.lit("x.JPG"))) and not one(spark, names.is_image(F.lit("jpg")))


def test_boxes(spark):
    rows = [(1, -5.7, -1.0, 95.9, 130.0), (2, 600.0, 400.0, 700.0, 520.0), (3, 700.0, 0.0, 800.0, 200.0), (4, 0.0, 0.0, 89.0, 120.0), (5, 0.0, 0.0, 90.0, 119.0), (6, 0.0, 0.0, 90.0, 120.0)]
    b = boxes.clamped(spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double"), F.lit(640), F.lit(480))
    assert b.where("id = 1").first()[1:] == (0, 0, 95, 130)
    assert {r.id for r in b.where(boxes.not_empty()).collect()} == {1, 2, 4, 5, 6}
    assert {r.id for r in b.where(boxes.not_empty() & boxes.large_enough()).collect()} == {1, 6}
