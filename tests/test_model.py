"""The one-class boundary against an exact solution of its dual."""

import numpy as np
import pytest

from tallyaudit.operators import model

NU = 0.1


def rows(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, len(model.FEATURES)))
    x[:, :4] = rng.normal(size=(n, 4)) * [1, 5, 0.2, 30] + np.where(rng.random(n) < 0.4, 6, 0)[:, None]
    x[: n // 20, :4] += rng.uniform(-40, 40, (n // 20, 4))
    return x


def exact_dual(k, nu, rounds=100_000):
    """Weights of the rows: least norm with a sum of 1 and at most 1 / (nu n) each; and the scores' boundary."""
    n, most = len(k), 1 / (nu * len(k))
    a = np.full(n, 1 / n)
    g = k @ a
    for _ in range(rounds):
        to, frm = np.where(a < most - 1e-15, g, np.inf).argmin(), np.where(a > 0, g, -np.inf).argmax()
        if g[frm] - g[to] < 1e-9:
            break
        step = min(a[frm], most - a[to], (g[frm] - g[to]) / max(k[to, to] + k[frm, frm] - 2 * k[to, frm], 1e-15))
        a[to] += step
        a[frm] -= step
        g += step * (k[to] - k[frm])
    return g, np.sort(g)[int(np.ceil(nu * n)) - 1]


@pytest.mark.parametrize("landmarks", [256, 60])
def test_boundary_agrees_with_the_exact_dual(spark, landmarks):
    x = rows()
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["sheet_id", *model.FEATURES]).coalesce(2)
    m = model.fit_one_class(table, nu=NU, landmarks=landmarks)
    z = (x - m.mean) / m.scale
    g, rho = exact_dual(model.rbf(z, z, m.gamma), NU)
    assert m.gap <= 1e-3 and len(m.landmarks) <= landmarks
    on = abs(g - rho) <= 1e-6 * rho  # an exact decision of zero, whose sign says nothing
    assert on.mean() < 0.1 and (on | ((m.decision(x) < 0) == (g < rho))).mean() >= 0.98
    if landmarks >= len(x):
        assert np.allclose(m.raw(x), g, atol=0.02 * g.max())


def test_repeated_and_equal_rows(spark):
    same = spark.createDataFrame([(i, *[float(i == 7)] * len(model.FEATURES)) for i in range(40)], ["sheet_id", *model.FEATURES]).coalesce(1)
    m = model.fit_one_class(same, nu=NU)
    out = {r["sheet_id"]: r for r in model.score(same, m).collect()}
    assert len(m.landmarks) == 2 and m.gap <= 1e-3
    assert [i for i, r in out.items() if r["score"] == min(v["score"] for v in out.values())] == [7]


def test_landmark_model_is_saved(spark, tmp_path):
    x = rows(40)
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["sheet_id", *model.FEATURES]).coalesce(1)
    m = model.fit_one_class(table, epochs=3)
    model.save_model(spark, m, str(tmp_path / "m"))
    again = model.load_model(spark, str(tmp_path / "m"))
    assert np.array_equal(again.decision(x), m.decision(x)) and (again.gap, again.n) == (m.gap, m.n)


def test_rows_near_the_boundary_give_the_same_fit(spark, monkeypatch):
    """A large table is lifted once per pass: bounds by a sample split off the rows that need a second look."""
    x = rows(3000)
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["sheet_id", *model.FEATURES]).coalesce(2)
    whole = model.fit_one_class(table, nu=NU, landmarks=40)
    monkeypatch.setattr(model, "BOUNDED_FROM", 100)
    monkeypatch.setattr(model, "SAMPLE", 1500)
    seen, near = [], model._near_boundary

    def watched(data, m, sample):
        found = near(data, m, sample)
        seen.append(found[0].count() if found[0] is not data else len(x))
        return found

    monkeypatch.setattr(model, "_near_boundary", watched)
    bounded = model.fit_one_class(table, nu=NU, landmarks=40)
    assert min(seen) < len(x) / 3 and bounded.gap <= 1e-3
    assert np.isclose(bounded.rho, whole.rho, rtol=1e-6) and np.allclose(bounded.raw(x), whole.raw(x), rtol=1e-5)
    near_rows, below, share = near(table, bounded, x[:400] - 1000.0)  # a sample that tells nothing: all rows
    assert near_rows is table and not below.any() and share == NU


@pytest.mark.parametrize("n", [0, 1, 3, 255, 256, 257, 259, 1027])
def test_blocks_of_rows_score_like_the_whole(n):
    rng = np.random.default_rng(n)
    m = model.LandmarkModel(mean=np.zeros(14), scale=np.ones(14), weights=rng.normal(size=60), rho=0.0, nu=NU, n=n, landmarks=rng.normal(size=(60, 14)), gamma=0.1)
    x = rng.normal(size=(n, 14))
    assert np.allclose(m.raw(x), m.lift(x) @ m.weights, rtol=1e-12, atol=1e-12)
    assert all(len(z) <= 2 * model.BLOCK for z, _ in m.lifted(x)) and sum(len(z) for z, _ in m.lifted(x)) == n
