import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.operators.kernels import Particles
from tidefold.operators.metrics import quadratic_form
from tidefold.plans import models
from tidefold.sources.files import read_table


@pytest.mark.parametrize("dim", [1, 2, 3, 4])
def test_quadratic_form_uses_the_pseudo_inverse(spark, dim):
    """Regular, singular and zero matrices, and rows that aren't finite or are null."""
    rng = np.random.default_rng(dim)
    rows, want = [], []
    for i in range(12):
        a = rng.normal(size=(dim, dim if i % 3 else max(dim - 1, 1)))
        p = a @ a.T if i % 4 else np.zeros((dim, dim))
        if i % 3 == 0 and dim == 2:
            p = np.outer([1.0, 2.0], [1.0, 2.0])
        if i % 3 == 0 and dim >= 3:
            p = np.diag([1.0] * (dim - 1) + [0.0])
        e = rng.normal(size=dim)
        rows.append((i, e.tolist(), p.tolist()))
        want.append(e @ (np.linalg.inv(p) if np.linalg.det(p) != 0 else np.linalg.pinv(p)) @ e)
    rows += [(12, [float("nan")] * dim, np.eye(dim).tolist()), (13, None, None)]
    df = spark.createDataFrame(rows, "i int, e array<double>, p array<array<double>>")
    got = [r["q"] for r in df.select("i", quadratic_form(F.col("e"), F.col("p"), dim).alias("q")).orderBy("i").collect()]
    assert np.allclose(got[:12], want, rtol=1e-6, atol=1e-9) and got[12] is None and got[13] is None


def test_default_resampling():
    assert Particles(models.create("model_x1_y1_markov_naive")).resampling == "stratified"


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-16"])
def test_encodings_are_detected(spark, tmp_path, encoding):
    file = tmp_path / "t.csv"
    file.write_bytes("name;n\nété;1\nmaïs;2\n".encode(encoding))
    assert [(r["name"], r["n"]) for r in read_table(spark, str(file)).collect()] == [("été", 1), ("maïs", 2)]
