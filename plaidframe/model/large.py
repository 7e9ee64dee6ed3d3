"""Fitting when the state vectors are too many for the driver.

The state variables, their gradient and the quasi-Newton history stay in one table
with a row per bin.  The two-loop recursion needs only inner products between those
vectors (Chen et al., 2014, vector-free L-BFGS), so an iteration collects one small
matrix of inner products, works out the coefficients of the search direction and
forms the new variables with column expressions.  Every table an iteration leaves
behind is checkpointed in the shared folder, which also bounds the lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..genome import Genome
from ..operators.reshape import reordered
from ..session import cut
from .frames import pixel_gradient, pixel_sums, with_zeros
from .mass import Model, pair_mass, pair_mass_gradient, pair_mass_sums
from .minimise import options_with_defaults
from .params import STATE_BOUNDS, STATE_START, Layout, ModelValues, permuted, state_order

MEMORY = 5


@dataclass
class LargeFit:
    """Fitted parameters with the states as a table ``(bin_id, probs)``."""

    states: DataFrame
    cis_weights: np.ndarray
    trans_weights: np.ndarray
    cis_dd_power: float
    trans_dd: float
    genome: Genome
    objective: float
    iterations: int
    success: bool
    message: str


@dataclass
class Point:
    """One evaluated point: table ``(bin_id, x, g)``, shared variables and gradients."""

    table: DataFrame
    shared: np.ndarray
    shared_grad: np.ndarray
    f: float


class DistributedObjective:
    """Negative log-likelihood for a table of state variables."""

    def __init__(self, pixels: DataFrame, genome: Genome, layout: Layout, *, dense: bool = True,
                 resolution: float | None = None, value: str = "count"):
        self.pixels, self.genome, self.layout = pixels, genome, layout
        self.dense, self.resolution, self.value = dense, resolution, value
        self.calls = 0
        # dense: cells without a value do not count towards Z
        blank = pixels.where((F.col("bin1_id") < F.col("bin2_id")) & F.col(value).isNull())
        self.blank = blank.withColumn(value, F.lit(0.0)) if dense and not blank.isEmpty() else None

    def evaluate(self, x: DataFrame, shared: np.ndarray) -> Point:
        """``x`` has ``(bin_id, x)``."""
        self.calls += 1
        n = self.layout.n_states
        values = self.layout.unpack(shared)
        total = F.col("x")[0]
        for k in range(1, n):
            total = total + F.col("x")[k]
        table = cut(x.select("bin_id", "x", total.alias("total"))
                    .withColumn("probs", F.array(*[F.col("x")[k] / F.col("total") for k in range(n)])))
        model = Model(table, self.genome, values.cis, values.trans, values.alpha, values.beta, self.resolution)
        sums = pixel_sums(model, self.pixels, self.value).first()
        if self.dense:
            mass = cut(pair_mass(model))
            zrow, prefix = pair_mass_sums(mass, model).first().asDict(), "z"
            second = pair_mass_gradient(mass, model)
            if self.blank is not None:
                less = pixel_sums(model, self.blank, self.value).first()
                zrow = {k: v - less["m" + k[1:]] for k, v in zrow.items()}
                taken = pixel_gradient(model, self.blank, self.value).select("bin_id", F.col("m").alias("b"))
                second = second.join(taken, "bin_id", "left").select("bin_id", F.array(
                    *[F.col("z")[k] - F.coalesce(F.col("b")[k], F.lit(0.0)) for k in range(n)]).alias("z"))
        else:
            zrow, prefix, second = sums, "m", None
        z, x_total = zrow[prefix], sums["x"]
        ratio = x_total / z

        def matrix(kind: str) -> np.ndarray:
            return np.array([[sums[f"x_{kind}_{s}_{t}"] - ratio * zrow[f"{prefix}_{kind}_{s}_{t}"]
                              for t in range(n)] for s in range(n)])

        down = ModelValues(np.zeros((0, n)), -matrix("cis"), -matrix("trans"),
                           -(sums["x_alpha"] - ratio * zrow[f"{prefix}_alpha"]),
                           -(sums["x_beta"] - ratio * zrow[f"{prefix}_beta"]))
        shared_grad = self.layout.gradient(shared, down)

        first = pixel_gradient(model, self.pixels, self.value).select("bin_id", F.col("x").alias("px"), "m")
        joined = table.join(first, "bin_id", "left")
        if second is not None:
            joined = joined.join(second, "bin_id", "left")
        by_mass = F.col("z") if second is not None else F.col("m")
        zero = F.lit(0.0)
        lam = [F.lit(ratio) * F.coalesce(by_mass[k], zero) - F.coalesce(F.col("px")[k], zero) for k in range(n)]
        joined = joined.withColumn("d", F.array(*lam))
        inner = F.col("d")[0] * F.col("probs")[0]
        for k in range(1, n):
            inner = inner + F.col("d")[k] * F.col("probs")[k]
        grad = joined.withColumn("inner", inner).select(
            "bin_id", "x", F.array(*[(F.col("d")[k] - F.col("inner")) / F.col("total") for k in range(n)]).alias("g"))
        return Point(cut(grad), shared, shared_grad, -(sums["x_ln_p"] - x_total * float(np.log(z))))


def _free(k: int) -> Column:
    low, high = STATE_BOUNDS
    x, g = F.col("x")[k], F.col("g")[k]
    return ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))


def _products(table: DataFrame, n_states: int, pairs: int) -> np.ndarray:
    """Inner products of ``g``, the steps and the changes over the free variables,
    plus the largest projected gradient, from one small row per task."""
    width = 1 + 2 * pairs
    low, high = STATE_BOUNDS
    masked = table.select("x", "g", "steps", "changes",
                          F.array(*[_free(k).cast("double") for k in range(n_states)]).alias("free"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, worst = np.zeros((width, width)), 0.0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x, g, free = (np.array(batch.column(c).to_pylist()) for c in (0, 1, 4))
            vectors = [g]
            for c in (2, 3):
                history = np.array(batch.column(c).to_pylist(), dtype=float).reshape(rows, pairs, n_states)
                vectors += [history[:, k] for k in range(pairs)]
            flat = np.stack([(v * free).ravel() for v in vectors])
            gram += flat @ flat.T
            worst = max(worst, float(np.abs(np.clip(x - g, low, high) - x).max()))
        yield pa.RecordBatch.from_pydict({"gram": pa.array([gram.ravel()], pa.list_(pa.float64())),
                                          "worst": pa.array([worst])})

    parts = masked.mapInArrow(part, "gram array<double>, worst double").collect()
    return sum(np.array(p["gram"]) for p in parts).reshape(width, width), max(p["worst"] for p in parts)


def direction(gram: np.ndarray, pairs: int) -> np.ndarray:
    """Coefficients of the quasi-Newton direction in the basis (g, steps, changes)."""
    coeff = np.zeros(1 + 2 * pairs)
    coeff[0] = -1.0
    good = [k for k in range(pairs) if gram[1 + k, 1 + pairs + k] > 1e-12 * gram[1 + pairs + k, 1 + pairs + k] > 0]
    used = []
    for k in reversed(good):
        s, y = 1 + k, 1 + pairs + k
        a = float(coeff @ gram[s]) / gram[s, y]
        coeff[y] -= a
        used.append(a)
    if good:
        s, y = 1 + good[-1], 1 + pairs + good[-1]
        coeff *= gram[s, y] / gram[y, y]
    for k, a in zip(good, reversed(used)):
        s, y = 1 + k, 1 + pairs + k
        coeff[s] += a - float(coeff @ gram[y]) / gram[s, y]
    return coeff


def _trial(table: DataFrame, coeff: np.ndarray, step: float, n_states: int, pairs: int) -> DataFrame:
    """``clip(x + step * direction)`` for the free variables."""
    low, high = STATE_BOUNDS
    moved = []
    for k in range(n_states):
        d = F.lit(float(coeff[0])) * F.col("g")[k]
        for p in range(pairs):
            d = d + F.lit(float(coeff[1 + p])) * F.col("steps")[p][k]
            d = d + F.lit(float(coeff[1 + pairs + p])) * F.col("changes")[p][k]
        x = F.col("x")[k]
        new = F.least(F.greatest(x + F.lit(float(step)) * d, F.lit(low)), F.lit(high))
        moved.append(F.when(_free(k), new).otherwise(x))
    return table.select("bin_id", F.array(*moved).alias("x"))


def _paired(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("bin_id", F.col("x").alias("x2"), F.col("g").alias("g2")), "bin_id")


def _difference(a: str, b: str, n: int) -> Column:
    return F.array(*[F.col(a)[k] - F.col(b)[k] for k in range(n)])


def minimise_distributed(objective: DistributedObjective, start: DataFrame, options: dict | None = None,
                         callback: Callable[[int, Point], None] | None = None) -> tuple[Point, int, bool, str]:
    opt = options_with_defaults(options)
    layout = objective.layout
    n, low, high = layout.n_states, layout.bounds[:, 0], layout.bounds[:, 1]
    point = objective.evaluate(start, layout.x0)
    empty = F.array().cast("array<array<double>>")
    table = point.table.withColumn("steps", empty).withColumn("changes", empty)
    shared_steps: list[np.ndarray] = []
    shared_changes: list[np.ndarray] = []
    iteration = 0
    while True:
        pairs = len(shared_steps)
        x, g = point.shared, point.shared_grad
        gram, worst = _products(table, n, pairs)
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)) | (low == high))
        basis = np.stack([np.where(free, v, 0.0) for v in (g, *shared_steps, *shared_changes)])
        gram = gram + basis @ basis.T
        worst = max(worst, float(np.abs(np.clip(x - g, low, high) - x).max(initial=0.0)))
        if worst <= opt["gtol"]:
            return point, iteration, True, "projected gradient below gtol"
        if iteration >= opt["maxiter"] or objective.calls >= opt["maxfun"]:
            return point, iteration, False, "limit reached"
        coeff = direction(gram, pairs)
        if pairs == 0 or float(coeff @ gram[0]) >= 0 or not np.isfinite(coeff).all():
            coeff = np.zeros(1 + 2 * pairs)
            coeff[0] = -1.0 / max(1.0, float(np.sqrt(gram[0, 0])))
        step, accepted = 1.0, None
        for _ in range(opt["maxls"]):
            shared = np.clip(x + step * (coeff @ basis), low, high)
            new = objective.evaluate(_trial(table, coeff, step, n, pairs), shared)
            both = _paired(table, new.table)
            slope_expr = sum((F.col("g")[k] * (F.col("x2")[k] - F.col("x")[k]) for k in range(n)), F.lit(0.0))
            slope = float(both.agg(F.sum(slope_expr)).first()[0]) + float(g @ (shared - x))
            if np.isfinite(new.f) and new.f <= point.f + 1e-4 * slope:
                accepted = new, both
                break
            if objective.calls >= opt["maxfun"]:
                break
            denom = 2.0 * (new.f - point.f - slope)
            step *= min(0.5, max(0.1, -slope / denom if np.isfinite(denom) and denom > 0 else 0.1))
        if accepted is None:
            return point, iteration, False, "no decrease along the search line"
        new, both = accepted
        drop = 1 if pairs == MEMORY else 0

        def appended(name: str, a: str, b: str) -> Column:
            kept = F.slice(name, 1 + drop, max(pairs - drop, 0)) if pairs - drop > 0 else empty
            return F.concat(kept, F.array(_difference(a, b, n))).alias(name)

        table = cut(both.select("bin_id", F.col("x2").alias("nx"), F.col("g2").alias("ng"),
                                appended("steps", "x2", "x"), appended("changes", "g2", "g"))
                    .select("bin_id", F.col("nx").alias("x"), F.col("ng").alias("g"), "steps", "changes"))
        shared_steps = [*shared_steps, new.shared - x][-MEMORY:]
        shared_changes = [*shared_changes, new.shared_grad - g][-MEMORY:]
        gain, old = point.f - new.f, point.f
        point = Point(table, new.shared, new.shared_grad, new.f)
        iteration += 1
        if callback:
            callback(iteration, point)
        if gain <= opt["ftol"] * max(abs(old), abs(new.f), 1.0):
            return point, iteration, True, "relative reduction below ftol"


def start_table(bins: DataFrame, n_states: int, seed: int) -> DataFrame:
    """Start values of the usable bins, uniform and independent of the partitioning."""
    low, high = STATE_START
    cells = []
    for k in range(n_states):
        unit = F.pmod(F.xxhash64(F.lit(seed), F.col("bin_id"), F.lit(k)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        cells.append(F.lit(low) + unit * F.lit(high - low))
    return bins.where(F.col("weight").isNotNull()).select("bin_id", F.array(*cells).alias("x"))


def fit_distributed(pixels: DataFrame, bins: DataFrame, genome: Genome, n_states: int = 2, *,
                    cis_shape: str = "symmetric", trans_shape: str = "symmetric", zeros: DataFrame | None = None,
                    zero_total: int = 0, dense: bool = True, resolution: float | None = None, seed: int = 0,
                    init: dict | None = None, fixed: dict | None = None, start: DataFrame | None = None,
                    options: dict | None = None, callback=None) -> LargeFit:
    """Dense or sparse fit of any size.  ``start`` is an optional table
    ``(bin_id, probs)`` of start values; ``init`` and ``fixed`` apply to the weights
    and the decay."""
    layout = Layout(np.zeros(0, dtype=bool), n_states, cis_shape, trans_shape, None, 0, init, fixed)
    cells = pixels
    if not dense and zeros is not None:
        cells = cut(with_zeros(pixels, zeros, zero_total, zeros.count()))
    objective = DistributedObjective(cells, genome, layout, dense=dense, resolution=resolution)
    if start is None:
        begin = start_table(bins, n_states, seed)
    else:
        low, high = STATE_BOUNDS
        begin = start.where("probs is not null").select(
            "bin_id", F.transform("probs", lambda p: F.least(F.greatest(p, F.lit(low)), F.lit(high))).alias("x"))
    point, iterations, success, message = minimise_distributed(objective, cut(begin), options, callback)
    values = layout.unpack(point.shared)
    order = [int(k) for k in state_order(values.cis)]
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    states = point.table.select("bin_id", "x", total.alias("t")).select(
        "bin_id", F.transform("x", lambda v: v / F.col("t")).alias("probs"))
    return LargeFit(reordered(states, order), permuted(values.cis, order), permuted(values.trans, order),
                    values.alpha, values.beta, genome, point.f, iterations, success, message)
