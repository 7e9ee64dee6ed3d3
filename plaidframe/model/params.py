"""Free variables of the compartment model and the chain rule back to them.

The optimiser works on one flat vector with box bounds:
state variables (usable bins x states), cis weight variables, trans weight
variables, the decay power and the trans constant.  State rows and weight matrices
are divided by their sums, which is how the sum-to-one constraints are met.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

# Bounds and start values of the model.
STATE_BOUNDS = (0.01, 0.99)
STATE_START = (0.25, 0.75)
WEIGHT_BOUNDS = (0.0, 1.0)
POWER_BOUNDS, POWER_START = (-2.0, -0.5), -1.0
TRANS_BOUNDS, TRANS_START = (-np.inf, 0.0), -2.0


@dataclass
class WeightShape:
    """How a weight matrix depends on its variables."""

    name: str
    n_states: int
    rows: np.ndarray = field(init=False)
    cols: np.ndarray = field(init=False)
    constant: np.ndarray | None = field(init=False, default=None)

    def __post_init__(self):
        n = self.n_states
        if self.name == "symmetric":
            self.rows, self.cols = np.tril_indices(n)
        elif self.name == "diag":
            self.rows = self.cols = np.arange(n)
        elif self.name in ("eye", "binary", "eye_with_empty"):
            self.rows = self.cols = np.zeros(1, dtype=int)
            diagonal = np.ones(n)
            if self.name == "eye_with_empty":
                diagonal[0] = 0.0
            self.constant = np.diag(diagonal)
        else:
            raise ValueError(f"unknown weight shape {self.name!r}")

    @property
    def size(self) -> int:
        return len(self.rows)

    def start(self) -> np.ndarray:
        if self.constant is not None:
            return np.zeros(1)
        on_diagonal = (self.rows == self.cols).astype(float)
        return on_diagonal / on_diagonal.sum()

    def flatten(self, matrix) -> np.ndarray:
        matrix = np.asarray(matrix)
        if self.constant is not None or matrix.ndim == 1:
            return np.ravel(matrix)[: self.size]
        return matrix[self.rows, self.cols]

    def _raw(self, variables: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return self.constant
        values = variables if np.any(variables) else np.ones(self.size)
        out = np.zeros((self.n_states, self.n_states))
        out[self.rows, self.cols] = values
        out[self.cols, self.rows] = values
        return out

    def matrix(self, variables: np.ndarray) -> np.ndarray:
        raw = self._raw(variables)
        return raw / raw.sum()

    def pull(self, variables: np.ndarray, grad: np.ndarray) -> np.ndarray:
        """Gradient with respect to the variables from the one for the matrix."""
        if self.constant is not None or not np.any(variables):
            return np.zeros(self.size)
        raw = self._raw(variables)
        total = raw.sum()
        inner = (grad - (grad * raw).sum() / total) / total
        both = inner[self.rows, self.cols] + inner[self.cols, self.rows]
        return np.where(self.rows == self.cols, both / 2.0, both)


@dataclass
class StateVariables:
    """Variables behind the state probabilities; a user function may replace any part."""

    count: int
    expand: Callable[[np.ndarray], np.ndarray]
    pull: Callable[[np.ndarray, np.ndarray], np.ndarray]
    start: np.ndarray
    bounds: np.ndarray
    flatten: Callable[[np.ndarray], np.ndarray]

    @classmethod
    def build(cls, usable: np.ndarray, n_states: int, rng: np.random.Generator,
              custom: Callable[[np.ndarray, int], dict] | None = None) -> "StateVariables":
        given = dict(custom(usable, n_states)) if custom else {}
        count = given.get("param_count", int(usable.sum()) * n_states)
        if "param_function" in given and "grad_function" not in given:
            raise ValueError("a custom param_function needs its grad_function")
        return cls(
            count,
            given.get("param_function", lambda v: v),
            given.get("grad_function", lambda v, g: g),
            np.asarray(given["init_values"], float) if "init_values" in given
            else rng.uniform(*STATE_START, size=count),
            np.asarray(given.get("bounds", [STATE_BOUNDS] * count), float).reshape(-1, 2),
            given.get("flatten_function", lambda a: np.asarray(a)[usable].ravel()),
        )


@dataclass
class ModelValues:
    """Model parameters at one point; ``states`` covers the usable bins only."""

    states: np.ndarray
    cis: np.ndarray
    trans: np.ndarray
    alpha: float
    beta: float


class Layout:
    """Maps the flat vector to model parameters and gradients back."""

    def __init__(self, usable: np.ndarray, n_states: int, cis_shape: str = "symmetric",
                 trans_shape: str = "symmetric", states: Callable | None = None, seed: int | None = None,
                 init: dict | None = None, fixed: dict | None = None):
        self.usable = np.asarray(usable, dtype=bool)
        self.n_states = n_states
        self.state_vars = StateVariables.build(self.usable, n_states, np.random.default_rng(seed), states)
        self.cis = WeightShape(cis_shape, n_states)
        self.trans = None if trans_shape == "none" else WeightShape(trans_shape, n_states)
        sizes = [self.state_vars.count, self.cis.size, self.trans.size if self.trans else 0, 1, 1]
        edges = np.cumsum([0, *sizes])
        self.parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        self.size = int(edges[-1])
        self.x0, self.bounds = self._start(dict(init or {}), dict(fixed or {}))

    def _start(self, init: dict, fixed: dict) -> tuple[np.ndarray, np.ndarray]:
        x0, bounds = np.empty(self.size), np.empty((self.size, 2))
        entries = [
            ("state_probabilities", self.state_vars.start, self.state_vars.bounds, self.state_vars.flatten),
            ("cis_weights", self.cis.start(), WEIGHT_BOUNDS, self.cis.flatten),
            ("trans_weights", self.trans.start() if self.trans else np.empty(0), WEIGHT_BOUNDS,
             self.trans.flatten if self.trans else None),
            ("cis_dd_power", POWER_START, POWER_BOUNDS, np.ravel),
            ("trans_dd", TRANS_START, TRANS_BOUNDS, np.ravel),
        ]
        for part, (name, start, limits, flatten) in zip(self.parts, entries):
            n = part.stop - part.start
            x0[part] = start
            bounds[part] = limits
            if n == 0:
                continue
            if init.get(name) is not None:
                value = np.asarray(init[name], dtype=float)
                value = flatten(value) if value.ndim > 1 else np.ravel(value)
                if value.size != n:
                    raise ValueError(f"{name} needs {n} start values, got {value.size}")
                x0[part] = value
            if fixed.get(name) is not None:
                value = np.asarray(fixed[name], dtype=float)  # None becomes NaN: free
                value = flatten(value) if value.ndim > 1 else np.ravel(value)
                if value.size > n:
                    raise ValueError(f"{name} takes at most {n} fixed values, got {value.size}")
                held = np.flatnonzero(np.isfinite(value))
                bounds[part][held] = value[held, None]
        return np.clip(x0, bounds[:, 0], bounds[:, 1]), bounds

    def unpack(self, x: np.ndarray) -> ModelValues:
        sv, cv, tv, a, b = (x[p] for p in self.parts)
        raw = self.state_vars.expand(sv).reshape(-1, self.n_states)
        cis = self.cis.matrix(cv)
        trans = self.trans.matrix(tv) if self.trans else cis
        return ModelValues(raw / raw.sum(axis=1, keepdims=True), cis, trans, float(a[0]), float(b[0]))

    def gradient(self, x: np.ndarray, grad: ModelValues) -> np.ndarray:
        """Chain a gradient in model parameters back to the flat vector."""
        sv, cv, tv, *_ = (x[p] for p in self.parts)
        raw = self.state_vars.expand(sv).reshape(-1, self.n_states)
        total = raw.sum(axis=1, keepdims=True)
        lam = raw / total
        d_raw = (grad.states - (grad.states * lam).sum(axis=1, keepdims=True)) / total
        out = np.empty(self.size)
        out[self.parts[0]] = self.state_vars.pull(sv, d_raw.ravel())
        if self.trans:
            out[self.parts[1]] = self.cis.pull(cv, grad.cis)
            out[self.parts[2]] = self.trans.pull(tv, grad.trans)
        else:
            out[self.parts[1]] = self.cis.pull(cv, grad.cis + grad.trans)
        out[self.parts[3]] = grad.alpha
        out[self.parts[4]] = grad.beta
        return out


def state_order(cis_weights: np.ndarray) -> np.ndarray:
    """States by ascending self-interaction."""
    return np.argsort(np.diag(cis_weights), kind="stable")


def permuted(weights: np.ndarray, order) -> np.ndarray:
    return np.asarray(weights)[np.ix_(order, order)]
