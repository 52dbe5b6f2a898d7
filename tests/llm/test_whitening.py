from collections import defaultdict

import llm_brute as brute
import numpy as np
import pytest

from jobledger.llm import whitening
from jobledger.llm.queries import op12_whitening

SF = "/root/testdata/sf0.001"


def check(rows, vectors, ids):
    n, deviations, e, want, trace = brute.whitening(vectors)
    by_id = {i: (d, w) for i, d, w in zip(ids, deviations, want, strict=True)}
    sign = {}
    assert len(rows) == len(ids) * len(e)
    for r in rows:
        deviation, w = by_id[r.vec_id]
        j = r.component - 1
        sign.setdefault(j, 1 if r.whitened * w[j] >= 0 else -1) if abs(w[j]) > 0.1 else None
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened - sign.get(j, np.sign(r.whitened * w[j])) * w[j]) < 1e-9
        assert abs(r.explained / (e[j] / trace) - 1) < 1e-9 and r.identity_error < 1e-9


def test_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(op12_whitening(spark, SF).collect(), [v for _, v in vectors], [i for i, _ in vectors])


def test_chebyshev_damps_the_rest():
    values = np.linspace(0, 2, 40)
    out = np.diag(whitening.chebyshev(lambda y: values[:, None] * y, np.eye(40), 10, 1.0, 2.0))
    assert abs(out[-1] - 1) < 1e-12 and np.abs(out[values <= 1]).max() < 1e-6
    assert (np.diff(out[values > 1]) > 0).all()


def test_close_and_few_eigenvalues():
    draw = np.random.default_rng(1)
    for values in (np.r_[5, 4.99, 3, 2.9, np.linspace(2, 0, 60)], np.r_[3, 2, 1, np.zeros(50)], np.array([2.0, 1.0]), np.ones(40)):
        d = len(values)
        u = np.linalg.qr(draw.standard_normal((d, d)))[0]
        v = (u * values) @ u.T
        e, q, residual, _ = whitening.leading(lambda y, v=v: v @ y, d, min(8, d), values.sum(), guard=4)
        assert residual < 1e-10 and np.allclose(e, values[:8][values[:8] > 0], atol=1e-10)
        assert np.allclose(v @ q, q * e, atol=1e-9) and np.allclose(q.T @ q, np.eye(len(e)), atol=1e-12)


def test_awkward_vectors(spark):
    draw = np.random.default_rng(2)
    good = [(i, [float(c) for c in v]) for i, v in enumerate(draw.standard_normal((40, 12)))]
    good += [(0, good[0][1]), (None, good[1][1])]
    bad = [(100, None), (101, [None] + [0.0] * 11), (102, [float("nan")] + [0.0] * 11), (103, [float("inf")] + [0.0] * 11), (104, []), (105, [1.0] * 7)]
    schema = "vec_id long, embedding array<double>, id string, x int, cell int"
    df = spark.createDataFrame([(*r, "c", 1, None) for r in good + bad], schema)
    rows = whitening.whiten(df).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.vec_id].append(r)
    assert len(rows) == 8 * len(good) and set(got) == {i for i, _ in good}
    _, _, e, want, _ = brute.whitening([v for _, v in good])
    for r in got[5]:
        assert abs(abs(r.whitened) - abs(want[5][r.component - 1])) < 1e-9
    for nothing in (df.where("false"), df.where("vec_id >= 100"), df.where("vec_id = 3")):
        out = whitening.whiten(nothing)
        assert out.collect() == [] and out.columns[0] == "vec_id"


def test_deviation_is_exact_or_null():
    x = np.array([[3, 5], [1 << 40, 7]])
    n, sums = 2, x.sum(0)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for v in x]
    assert whitening._deviation(x, n, sums) == [v if v < 1 << 63 else None for v in exact]


@pytest.mark.parametrize("k", [1, 3])
def test_fewer_components(spark, k):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = whitening.whiten(df, k=k)
    assert {r.component for r in rows.select("component").distinct().collect()} == set(range(1, k + 1))
