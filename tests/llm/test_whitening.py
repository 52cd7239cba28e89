import random
from fractions import Fraction

import numpy as np
import pytest

from weftline.llm import whitening
from weftline.llm.whitening import digits, fit, gram, gram_slices, integers, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n string, component long"


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 0, 1, "a", 2) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def plain(vectors):
    """Exact statistics with Fractions."""
    xs = [[int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    v = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs), n**3) for j in range(d)] for i in range(d)]
    return xs, s, v


@pytest.mark.parametrize("scale", [0.5, 3000.0, 1e9, 1e15])
def test_slices_are_exact(scale):
    r = np.random.default_rng(3)
    y = (r.standard_normal((50, 7)) * scale).astype(np.int64)
    y[0, 0], y[1, 1] = -(1 << 19), (1 << 19)
    assert all(np.abs(p).max() <= 1 << 19 for p in digits(y))
    assert (sum(p.astype(object).astype(int) * (1 << 20 * k) for k, p in enumerate(digits(y))) == y).all()
    got = sum(m.astype(object) * (1 << 20 * p) for p, m in gram_slices(y).items())
    assert (got == y.astype(object).T @ y.astype(object)).all()


def test_full_batches_stay_exact():
    y = np.full((whitening.BATCH_ROWS, 2), -(1 << 19), dtype=np.int64)
    assert gram_slices(y)[0][0, 1] == whitening.BATCH_ROWS << 38


def test_against_fractions(spark):
    r = random.Random(5)
    vectors = [[r.gauss(0, 0.3 * (j + 1)) + 2 * (j == 3) for j in range(6)] for _ in range(90)]
    vectors += [vectors[0]] * 20  # repeated rows count
    df = frame(spark, vectors)
    xs, s, v = plain(vectors)
    n = len(xs)
    model = fit(integers(df))
    assert model.n == n and model.sums == s
    centre = [(2 * a + n) // (2 * n) for a in s]
    assert gram(integers(df), centre) == [[sum((x[i] - centre[i]) * (x[j] - centre[j]) for x in xs) for j in range(6)] for i in range(6)]
    exact = np.array([[float(e) for e in row] for row in v])
    want = np.linalg.eigvalsh(exact)[::-1]
    assert np.allclose(model.values, want, rtol=1e-9) and np.allclose(model.trace, np.trace(exact), rtol=1e-14)
    assert np.allclose(exact @ model.vectors, model.vectors * model.values, atol=1e-9 * want[0])
    got = whiten(df).collect()
    assert len(got) == n * 6
    assert [f.name for f in whiten(df).schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for g in got:
        x = xs[g.vec_id]
        assert g.n == n and g.deviation == sum((n * x[i] - s[i]) ** 2 for i in range(6))
        k = g.component - 1
        w = sum(float(Fraction(n * x[i] - s[i], n)) * model.vectors[i, k] for i in range(6)) / want[k] ** 0.5
        assert abs(g.whitened - w) < 1e-9 and abs(g.explained - want[k] / want.sum()) < 1e-9 and g.identity_error < 1e-8


def test_small_variance_beside_a_large_offset(spark):
    """A float64 Gram matrix of x itself would lose these eigenvalues."""
    vectors = [[1e5 + (i % 3) / 64, (i % 2) / 64] for i in range(60)]
    got = whiten(frame(spark, vectors))
    assert {r.component for r in got.collect()} == {1, 2} and got.first().identity_error < 1e-9


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [1.0, None], [nan, 1.0], [1.0, -inf], [1.0, 2.0], [1.5, 2.5], [0.0, 2.0], [3.0], [1.0, 2.0, 3.0]]
    got = whiten(frame(spark, vectors)).collect()
    assert {r.vec_id for r in got} == {5, 6, 7} and got[0].n == 3
    ids = spark.createDataFrame([(None, [1.0, 0.0]), (4, [0.0, 1.0]), (4, [0.5, 0.9])], "vec_id long, embedding array<float>")
    assert sorted(str(r.vec_id) for r in whiten(ids).where("component = 1").collect()) == ["4", "4", "None"]
    constant = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<float>")
    assert {r.component for r in whiten(constant).collect()} == {1}  # the constant dimension has no component
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")).count() == 0
    empty = whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.count() == 0 and len(empty.columns) == 7


def test_same_result_for_any_partitioning(spark):
    r = random.Random(1)
    vectors = [[r.random() for _ in range(4)] for _ in range(50)]
    one, many = (sorted(whiten(frame(spark, vectors, p)).select("vec_id", "component", "deviation", "whitened").collect()) for p in (1, 7))
    assert [a[:3] for a in one] == [b[:3] for b in many] and np.allclose([a[3] for a in one], [b[3] for b in many], rtol=1e-12)
