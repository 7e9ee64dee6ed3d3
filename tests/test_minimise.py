import numpy as np
import pytest

from plaidframe.model.minimise import minimise


def rosenbrock(x):
    f = float(sum(100 * (x[1:] - x[:-1] ** 2) ** 2 + (1 - x[:-1]) ** 2))
    g = np.zeros_like(x)
    g[:-1] += -400 * x[:-1] * (x[1:] - x[:-1] ** 2) - 2 * (1 - x[:-1])
    g[1:] += 200 * (x[1:] - x[:-1] ** 2)
    return f, g


def test_unconstrained_minimum():
    bounds = np.array([[-5.0, 5.0]] * 4)
    result = minimise(rosenbrock, np.array([0.2, 1.5, 0.5, 2]), bounds, {"ftol": 1e-15})
    assert result.success and result.status == 0
    np.testing.assert_allclose(result.x, 1, atol=1e-5)


def test_active_bounds_and_fixed_values():
    bounds = np.array([[-5.0, 0.5], [-5.0, 5.0], [0.3, 0.3]])
    result = minimise(lambda x: (float(((x - 1) ** 2).sum()), 2 * (x - 1)), np.zeros(3), bounds, {"ftol": 1e-15})
    np.testing.assert_allclose(result.x, [0.5, 1.0, 0.3], atol=1e-6)


def test_resuming_continues_the_same_path():
    bounds = np.array([[-5.0, 5.0]] * 3)
    x0 = np.array([-1.2, 1.0, 0.4])
    saved = []
    full = minimise(rosenbrock, x0, bounds, {"maxiter": 20}, callback=saved.append)
    part = minimise(rosenbrock, x0, bounds, {"maxiter": 20}, state=saved[7])
    np.testing.assert_array_equal(full.x, part.x)
    assert full.nit == part.nit == 20 and full.status == 1


def test_limits_unknown_options_and_infinite_values():
    bounds = np.array([[-5.0, 5.0]] * 2)
    assert minimise(rosenbrock, np.array([3.0, -2]), bounds, {"maxfun": 3}).status == 1
    with pytest.warns(RuntimeWarning):
        minimise(rosenbrock, np.array([0.9, 0.9]), bounds, {"nonsense": 1, "maxiter": 1})

    def barrier(x):
        if x[0] <= 0:
            return np.inf, np.full(1, np.nan)
        return float(x[0] - np.log(x[0])), 1 - 1 / x

    assert minimise(barrier, np.array([3.0]), np.array([[-10.0, 10.0]]), {"ftol": 1e-15}).x[0] == pytest.approx(1, abs=1e-5)


def test_inverse_hessian_of_a_quadratic():
    a = np.diag([1.0, 4.0])
    result = minimise(lambda x: (float(x @ a @ x) / 2, a @ x), np.array([3.0, 2.0]), np.array([[-9.0, 9.0]] * 2))
    np.testing.assert_allclose(result.inverse_hessian(np.array([0.0, 1.0]))[1], 0.25, rtol=0.2)
