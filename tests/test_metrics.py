import numpy as np
import pytest
from helpers import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simvane.errors import VectorIndexError
from simvane.functions import metrics as M
from simvane.functions.metrics import Metric

HAND = [
    (Metric.DOT, [1, 2, 3], [4, 5, 6], 32),
    (Metric.L2, [1, 2, 3], [4, 6, 3], 25),
    (Metric.MANHATTAN, [1, 2, 3], [4, -6, 3], 11),
    (Metric.MINKOWSKI, [1, 2, 3], [4, 6, 3], 91 ** (1 / 3)),
    (Metric.CHEBYSHEV, [1, 2, 3], [4, 10, 3], 8),
    (Metric.HAMMING, [1, 2, 3], [1, 5, 6], 2),
    (Metric.MAHALANOBIS, [0, 0], [3, 4], 5),
    (Metric.COSINE, [0, 0], [1, 2], 0),
    (Metric.COSINE, [1, 1], [2, 2], 1),
    (Metric.JACCARD, [1, 0, 2], [1, 3, 2], 0.5),
    (Metric.JACCARD, [0, 0], [0, 0], 0),
    (Metric.HELLINGER, [1, 4], [-1, 9], 0.5**0.5),
]


def scored(spark, column, a, b):
    df = frame(spark, [([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    return df.select(column(F.col("a"), F.col("b")).alias("s")).first()["s"]


@pytest.mark.parametrize(("metric", "a", "b", "want"), HAND)
def test_hand_values(spark, metric, a, b, want):
    assert scored(spark, lambda x, y: M.score_expr(metric, x, y), a, b) == pytest.approx(want, abs=1e-6)
    assert M.score_matrix(metric, np.array([a]), np.array([b]))[0, 0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("dim", [1, 7, 16, 65])
def test_expression_and_kernel_agree(spark, metric, dim):
    a, b = [((i * 7 + 3) % 100) * 0.1 for i in range(dim)], [((i * 13 + 5) % 100) * 0.1 for i in range(dim)]
    kernel = M.score_matrix(metric, np.float32([a]), np.float32([b]))[0, 0]
    assert scored(spark, lambda x, y: M.score_expr(metric, x, y), a, b) == pytest.approx(kernel, rel=1e-9, abs=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-50, 50, width=32), min_size=1, max_size=12), st.sampled_from(list(Metric)))
def test_identity_and_symmetry(values, metric):
    x = np.array([values])
    y = x[:, ::-1]
    assert M.score_matrix(metric, x, y)[0, 0] == pytest.approx(M.score_matrix(metric, y, x)[0, 0], rel=1e-9, abs=1e-9)
    if not metric.higher_is_better:
        assert M.score_matrix(metric, x, x)[0, 0] == 0


def test_parametric_forms(spark):
    a, b = [1, 2, 3], [4, 6, 3]
    assert scored(spark, lambda x, y: M.minkowski_expr(x, y, 1), a, b) == pytest.approx(7)
    assert scored(spark, lambda x, y: M.minkowski_expr(x, y, 4), a, b) == pytest.approx((81 + 256) ** 0.25)
    assert scored(spark, lambda x, y: M.mahalanobis_expr(x, y, [1.0, 0.25]), [0, 0], [3, 4]) == pytest.approx(13**0.5)
    assert scored(spark, lambda x, y: M.mahalanobis_expr(x, y, [2.0, 1.0, 1.0, 2.0]), [0, 0], [3, 4]) == pytest.approx(74**0.5)
    with pytest.raises(VectorIndexError):
        M.minkowski_expr(F.lit(1), F.lit(1), 0)
    with pytest.raises(Exception, match="precision"):
        scored(spark, lambda x, y: M.mahalanobis_expr(x, y, [1.0, 2.0, 3.0]), [0, 0], [3, 4])


def test_names_and_codes():
    assert M.parse("Euclidean") is Metric.L2 and M.parse("TANIMOTO") is Metric.JACCARD and M.parse("l_inf") is Metric.CHEBYSHEV
    assert [m.file_code for m in Metric] == list(range(10)) and [m.wire_code for m in Metric] == list(range(1, 11))
    assert M.from_wire_code(0) is None and M.from_wire_code(99) is None and M.from_file_code(9) is Metric.HELLINGER
    assert M.parse("nonsense", strict=False) is Metric.L2
    with pytest.raises(VectorIndexError):
        M.parse("nonsense")
    with pytest.raises(VectorIndexError):
        M.from_file_code(10)
    assert {m for m in Metric if m.higher_is_better} == {Metric.DOT, Metric.COSINE}
