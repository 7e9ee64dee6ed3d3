"""Box-constrained limited-memory quasi-Newton minimiser with resumable state.

Projected L-BFGS: variables held at a bound by the gradient are left out, the
two-loop recursion gives a direction for the others, and a backtracking search
follows the projection of that line.  The loop itself only handles the parameter
vector; every objective call is a distributed job.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

# Default stopping rules.
DEFAULTS = {"ftol": 1e-9, "gtol": 1e-9, "maxiter": 10_000_000, "maxfun": 10_000_000,
            "maxls": 100, "memory": 10, "disp": False}


@dataclass
class State:
    """Everything needed to go on from an iteration."""

    iteration: int
    x: np.ndarray
    f: float
    g: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)
    changes: list[np.ndarray] = field(default_factory=list)


@dataclass
class Result:
    x: np.ndarray
    fun: float
    jac: np.ndarray
    nit: int
    nfev: int
    success: bool
    status: int
    message: str
    state: State

    def inverse_hessian(self, vector: np.ndarray) -> np.ndarray:
        """Product of the inverse Hessian estimate with ``vector``."""
        return two_loop(vector, self.state.steps, self.state.changes)


def options_with_defaults(options: dict | None) -> dict:
    merged = dict(DEFAULTS)
    for key, value in (options or {}).items():
        if key not in merged:
            warnings.warn(f"unknown optimiser option {key!r}", RuntimeWarning, stacklevel=3)
            continue
        merged[key] = value
    return merged


def two_loop(vector: np.ndarray, steps: list, changes: list) -> np.ndarray:
    q = vector.copy()
    pairs = [(s, y, float(s @ y)) for s, y in zip(steps, changes)]
    pairs = [p for p in pairs if p[2] > 1e-12 * float(p[1] @ p[1])]
    coeffs = []
    for s, y, sy in reversed(pairs):
        a = float(s @ q) / sy
        q -= a * y
        coeffs.append(a)
    if pairs:
        s, y, sy = pairs[-1]
        q *= sy / float(y @ y)
    for (s, y, sy), a in zip(pairs, reversed(coeffs)):
        q += (a - float(y @ q) / sy) * s
    return q


def minimise(fun: Callable[[np.ndarray], tuple[float, np.ndarray]], x0: np.ndarray, bounds: np.ndarray,
             options: dict | None = None, callback: Callable[[State], None] | None = None,
             state: State | None = None) -> Result:
    opt = options_with_defaults(options)
    low, high = bounds[:, 0], bounds[:, 1]
    calls = 0

    def evaluate(x):
        nonlocal calls
        calls += 1
        f, g = fun(x)
        return float(f), np.asarray(g, dtype=float)

    if state is None:
        x = np.clip(np.asarray(x0, dtype=float), low, high)
        f, g = evaluate(x)
        state = State(0, x, f, g)

    def finish(status, message):
        return Result(state.x, state.f, state.g, state.iteration, calls, status == 0, status, message, state)

    while True:
        x, f, g = state.x, state.f, state.g
        projected = np.clip(x - g, low, high) - x
        if np.max(np.abs(projected), initial=0.0) <= opt["gtol"]:
            return finish(0, "CONVERGENCE: projected gradient below gtol")
        if state.iteration >= opt["maxiter"]:
            return finish(1, "STOP: iteration limit reached")
        if calls >= opt["maxfun"]:
            return finish(1, "STOP: evaluation limit reached")

        held = ((x <= low) & (g > 0)) | ((x >= high) & (g < 0)) | (low == high)
        free = ~held
        direction = np.zeros_like(x)
        direction[free] = -two_loop(g[free], [s[free] for s in state.steps], [y[free] for y in state.changes])
        if not state.steps or float(direction @ g) >= 0 or not np.isfinite(direction).all():
            state.steps, state.changes = [], []
            direction = np.where(free, -g, 0.0)
            direction /= max(1.0, float(np.linalg.norm(direction)))

        accepted = None
        step = 1.0
        for _ in range(opt["maxls"]):
            trial = np.clip(x + step * direction, low, high)
            move = trial - x
            if not np.any(move):
                break
            f_new, g_new = evaluate(trial)
            if np.isfinite(f_new) and f_new <= f + 1e-4 * float(g @ move):
                accepted = trial, f_new, g_new
                break
            if calls >= opt["maxfun"]:
                return finish(1, "STOP: evaluation limit reached")
            # quadratic fit through f, slope and f_new, kept within a tenth and a half
            slope = float(g @ move)
            denom = 2.0 * (f_new - f - slope)
            shrink = -slope / denom if np.isfinite(denom) and denom > 0 else 0.1
            step *= min(0.5, max(0.1, shrink))
        if accepted is None:
            if state.steps:  # start again from steepest descent once
                state.steps, state.changes = [], []
                continue
            return finish(2, "ABNORMAL: no decrease along the search line")

        trial, f_new, g_new = accepted
        s, y = trial - x, g_new - g
        steps, changes = state.steps, state.changes
        if float(s @ y) > 1e-10 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            steps, changes = [*steps, s][-opt["memory"]:], [*changes, y][-opt["memory"]:]
        state = State(state.iteration + 1, trial, f_new, g_new, steps, changes)
        if callback:
            callback(state)
        if opt["disp"]:
            print(f"iteration {state.iteration}: objective {f_new:.10g}")
        if (f - f_new) <= opt["ftol"] * max(abs(f), abs(f_new), 1.0):
            return finish(0, "CONVERGENCE: relative reduction below ftol")
