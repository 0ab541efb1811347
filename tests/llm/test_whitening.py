import numpy as np
import pytest

from shearmark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, key string, x int"


def vectors(seed, n=400, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)) @ np.diag(np.linspace(0.05, 1.5, dim)) @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    return base.astype(np.float32)


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, "k", 1) for i, v in rows], SCHEMA)


def brute(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] for _, v in good])
    fit = np.array(sorted({tuple(r) for r in x.tolist()}))
    n, total = len(fit), fit.sum(axis=0)
    values, units = np.linalg.eigh(np.cov(fit.T, bias=True))
    return [i for i, _ in good], x, n, total, values[::-1], units[:, ::-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_dense_solver(spark, seed):
    v = vectors(seed)
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    rows += [(1000, None), (1001, [None] * 24), (1002, [float("nan")] * 24), (1003, [float("inf")] + [0.0] * 23), (7, v[7].tolist()),
             (None, v[8].tolist())] + [(2000 + i, v[9].tolist()) for i in range(200)]
    got = whitening.whiten(frame_of(spark, rows)).collect()
    ids, x, n, total, values, units = brute(rows)
    assert len(got) == 16 * len(ids) and {g.n for g in got} == {n}
    table = {}
    for g in got:
        table.setdefault(g.vec_id, {}).setdefault(g.component, []).append(g)
    assert all(g.identity_error < 1e-8 for g in got)
    for k in range(16):
        signs = {int(np.sign(table[i][k + 1][0].whitened * float(((r - total / n) @ units[:, k])))) for i, r in zip(ids[:50], x[:50])}
        assert len(signs) == 1
        sign = signs.pop()
        for i, r in zip(ids, x):
            for g in table[i][k + 1]:
                assert g.whitened == pytest.approx(sign * float((r - total / n) @ units[:, k]) / values[k] ** 0.5, abs=1e-7)
                assert g.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
                assert int(g.deviation) == sum((n * a - t) ** 2 for a, t in zip(r.tolist(), total.tolist()))


def test_special_tables(spark):
    out = whitening.whiten(frame_of(spark, []).limit(0))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
    assert whitening.whiten(frame_of(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [])])).count() == 0  # no variance
    flat = whitening.whiten(frame_of(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(5)])).collect()  # one direction only
    assert len(flat) == 5 and {f.component for f in flat} == {1} and flat[0].explained == pytest.approx(1)
    mixed = whitening.whiten(frame_of(spark, [(i, [float(i)] * (1 + i % 2)) for i in range(8)])).collect()  # two lengths
    assert len(mixed) == 8 and {m.n for m in mixed} == {4}
    wide = whitening.whiten(frame_of(spark, [(i, [float(i) * 1e9, 0.0]) for i in range(9)])).collect()  # beyond 64 bits
    sums = 9 * 1000000 + sum(int(64 * float(np.float32(i * 1e9))) for i in range(9))
    for w in wide:
        x = int(64 * float(np.float32(w.vec_id * 1e9))) + 1000000
        assert int(w.deviation) == (9 * x - sums) ** 2


@pytest.mark.parametrize("dim, spread", [(300, 1.0), (300, 0.97), (40, 0.5)])
def test_solver(dim, spread):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    values = spread ** np.arange(dim) if spread < 1 else np.r_[np.linspace(10, 5, 20), np.linspace(1, 0, dim - 20)]
    a = (q * values) @ q.T
    calls = []
    found, units = whitening.jacobi_davidson(lambda y: (calls.append(1), a @ y)[1], dim, 16)
    assert np.allclose(found, values[:16], rtol=1e-11) and len(calls) < 200
    assert np.abs(a @ units - units * found).max() < 1e-12 * values[0] and np.allclose(units.T @ units, np.eye(16), atol=1e-12)


def test_minres_solves():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    b = rng.standard_normal((20, 3))
    assert np.allclose(a @ whitening.minres(lambda y: a @ y, b, 20), b, atol=1e-6)
