"""Matrix-Market and JSON round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.matrix import Matrix, ShapeError, mirrored, uniform
from gridloom.operators.rows import small as array
from gridloom.sources import json_matrix, matrix_market


@pytest.fixture
def scattered(spark):
    """Every range in a file of its own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("form", ["array", "coordinate"])
@pytest.mark.parametrize("symmetric", [False, True])
def test_market_files(spark, tmp_path, scattered, form, symmetric):
    a = uniform(spark, 40, 40, 3)
    a = mirrored(a) if symmetric else a
    path = f"{tmp_path}/m"
    matrix_market.write(a, path, form, symmetric)
    assert len(spark.read.text(path).inputFiles()) > 1
    back = matrix_market.read(spark, path, mirror=symmetric)
    assert (back.rows, back.cols) == (40, 40) and np.allclose(array(back), array(a), atol=1e-13)


def test_market_text(spark, tmp_path):
    path = tmp_path / "a.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real symmetric\n% a comment\n3 3 2\n1 1 2.5\n3 1 -1\n")
    half, full = matrix_market.read(spark, str(path)), matrix_market.read(spark, str(path), mirror=True)
    assert half.df.count() == 2 and array(full)[0, 2] == array(full)[2, 0] == -1
    path.write_text("%%MatrixMarket matrix array complex general\n1 1\n1 0\n")
    with pytest.raises(matrix_market.FormatError):
        matrix_market.read(spark, str(path))


@pytest.mark.parametrize("sparse", [False, True])
def test_json(spark, sparse):
    a = uniform(spark, 5, 7, 2)
    texts = json_matrix.write(a, sparse).withColumn("key", F.lit(9))
    rows = json_matrix.read(texts)
    assert {r["key"] for r in rows.collect()} == {9} and np.allclose(array(Matrix(rows.select("i", "j", "v"), 5, 7)), array(a))


def test_json_that_is_no_matrix(spark):
    texts = spark.createDataFrame([(1, "nonsense"), (2, '{"rows":1,"cols":1,"data":[[1,0,5.0],[0,0,2.0]]}'), (3, None)], "key long, json string")
    assert [(r["key"], r["v"]) for r in json_matrix.read(texts).collect()] == [(2, 2.0)]


def test_json_faults_are_counted_or_raised(spark):
    rows = [(1, "nonsense"), (2, '{"rows":1,"cols":1,"data":[[1,0,5.0],[0,0,2.0],[0,0]]}'), (3, None), (4, '{"rows":2,"cols":2,"data":[1,2,3]}'), (5, '{"rows":0,"cols":3,"data":[]}'), (None, '{"rows":1,"cols":2,"data":[1.5,2.5]}')]
    texts = spark.createDataFrame(rows, "key long, json string")
    got = {r["key"]: (r["matrix"], r["whole"], r["dropped"]) for r in json_matrix.faults(texts).collect()}
    assert got == {1: (False, False, 0), 2: (True, True, 2), 4: (True, False, 0), 5: (True, True, 0), None: (True, True, 0)}
    good = texts.where("key is null or key in (3, 5)")
    assert sorted(r["v"] for r in json_matrix.read(good, strict=True).collect()) == [1.5, 2.5]
    for key in (1, 2, 4):
        with pytest.raises(Exception, match=f"no whole matrix: {key}"):
            json_matrix.read(texts.where(F.col("key") == key), strict=True).collect()


@pytest.mark.parametrize("sparse", [False, True])
def test_json_documents_of_some_columns(spark, sparse):
    a = uniform(spark, 4, 11, 5)
    parts = json_matrix.write_parts(a, sparse, columns=3)
    cells = json_matrix.read(parts, "part", strict=True).collect()
    back = np.zeros((4, 11))
    for r in cells:
        back[r["i"], r["j"] + 3 * r["key"]] = r["v"]
    assert parts.count() == 4 and np.allclose(back, array(a))
    with pytest.raises(ShapeError):
        json_matrix.write(a, sparse, most=40)
