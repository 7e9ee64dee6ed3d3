"""Fitting: dense, sparse and decay-only models, several starts, warm starts."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..genome import Genome
from ..operators.clean import deduplicated
from ..operators.zeros import sample_zeros, total_zeros
from ..session import may_broadcast
from .checkpoint import OptimiserCheckpoint
from .minimise import Result, minimise
from .objective import PixelObjective
from .params import Layout, ModelValues, permuted, state_order
from .regularise import resolve


@dataclass
class Fit:
    """Parameters of a fitted model; unusable bins have NaN states."""

    state_probabilities: np.ndarray
    cis_weights: np.ndarray
    trans_weights: np.ndarray
    cis_dd_power: float
    trans_dd: float
    genome: Genome
    result: Result | None = None
    metadata: dict = field(default_factory=dict)

    @property
    def n_states(self) -> int:
        return self.cis_weights.shape[0]

    @property
    def objective(self) -> float:
        return self.result.fun if self.result else float(self.metadata["optimize_value"])

    def states_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, None if np.isnan(p).any() else p.tolist()) for k, p in enumerate(self.state_probabilities)]
        return spark.createDataFrame(rows, "bin_id int, probs array<double>")

    def start_values(self) -> dict:
        return {"state_probabilities": self.state_probabilities, "cis_weights": self.cis_weights,
                "trans_weights": self.trans_weights, "cis_dd_power": self.cis_dd_power,
                "trans_dd": self.trans_dd}


def usable_mask(bins: DataFrame, n_bins: int, weight: str = "weight") -> np.ndarray:
    """Usability of every bin as a flag vector, for state tables within the broadcast limit."""
    if not may_broadcast(bins.sparkSession, n_bins, 16):
        raise ValueError("state vectors exceed the broadcast limit, use fit_distributed")
    ids = bins.where(F.col(weight).isNotNull()).select("bin_id").toArrow().column(0).to_numpy()
    mask = np.zeros(n_bins, dtype=bool)
    mask[ids] = True
    return mask


def _run(objective: PixelObjective, layout: Layout, genome: Genome, options: dict | None, ridge: float,
         regularisation, checkpoint: OptimiserCheckpoint | None, restore: bool,
         debug: Callable | None) -> Fit:
    penalty = resolve(regularisation)

    def fun(x: np.ndarray) -> tuple[float, np.ndarray]:
        values = layout.unpack(x)
        ll, grad = objective.evaluate(values)
        if ridge:
            reg, reg_grad = penalty(values.states)
        else:
            reg, reg_grad = 0.0, 0.0
        down = ModelValues(ridge * reg_grad - grad.states, -grad.cis, -grad.trans, -grad.alpha, -grad.beta)
        out = -ll + ridge * reg, layout.gradient(x, down)
        if debug:
            debug(out, x)
        return out

    resumed = checkpoint.restore() if checkpoint and restore else None
    try:
        result = minimise(fun, layout.x0, layout.bounds, options,
                          callback=checkpoint.save if checkpoint else None, state=resumed)
        if checkpoint:
            checkpoint.save(result.state, force=True)
    finally:
        objective.close()
    values = layout.unpack(result.x)
    order = state_order(values.cis)
    states = np.full((genome.n_bins, layout.n_states), np.nan)
    states[layout.usable] = values.states
    return Fit(states[:, order], permuted(values.cis, order), permuted(values.trans, order),
               values.alpha, values.beta, genome, result,
               {"optimize_value": result.fun, "optimize_success": result.success,
                "optimize_iterations": result.nit})


def _layout(usable: np.ndarray, n_states: int, cis_shape: str, trans_shape: str, states, seed, init, fixed) -> Layout:
    init = dict(init or {})
    if trans_shape == "none":
        init.pop("trans_weights", None)
    return Layout(usable, n_states, cis_shape, trans_shape, states, seed, init, fixed)


def fit_dense(pixels: DataFrame, bins: DataFrame, genome: Genome, n_states: int = 2, *,
              cis_shape: str = "symmetric", trans_shape: str = "symmetric", states: Callable | None = None,
              init: dict | None = None, fixed: dict | None = None, options: dict | None = None,
              regularisation=None, strength: float = 0.0, resolution: float = 1.0, seed: int | None = None,
              checkpoint: OptimiserCheckpoint | None = None, restore: bool = True,
              debug: Callable | None = None, value: str = "count") -> Fit:
    """Fit with Z over every usable pair, zero cells included."""
    usable = usable_mask(bins, genome.n_bins)
    layout = _layout(usable, n_states, cis_shape, trans_shape, states, seed, init, fixed)
    objective = PixelObjective(pixels, usable, genome, n_states, dense=True, resolution=resolution, value=value)
    return _run(objective, layout, genome, options, strength, regularisation, checkpoint, restore, debug)


def fit_sparse(pixels: DataFrame, bins: DataFrame, genome: Genome, n_states: int = 2, *,
               zeros: DataFrame | None = None, n_zeros: int | None = None, zero_total: int | None = None,
               zero_seed: int = 0, area: str = "both", cis_shape: str = "symmetric",
               trans_shape: str = "symmetric", states: Callable | None = None, init: dict | None = None,
               fixed: dict | None = None, options: dict | None = None, seed: int | None = None,
               checkpoint: OptimiserCheckpoint | None = None, restore: bool = True,
               debug: Callable | None = None, value: str = "count", dups: str = "keep",
               dups_order: str | None = None) -> Fit:
    """Fit with Z over stored pixels and (sampled) zero cells.

    ``dups`` says what becomes of cells that are stored more than once: ``keep`` takes each
    as a term of its own, ``fix`` adds them up, ``remove`` drops them, ``ignore`` takes the
    first by the column ``dups_order``.  In any case they are one cell when zeros are counted.
    """
    pixels = deduplicated(pixels, dups, value, dups_order)
    usable = usable_mask(bins, genome.n_bins)
    held = pixels.select("bin1_id", "bin2_id").distinct()
    if zero_total is None and (n_zeros is not None or zeros is not None):
        zero_total = total_zeros(held, bins, genome, area)
    if n_zeros is not None:
        zeros = sample_zeros(held, bins, genome, n_zeros, zero_seed, area, total=zero_total)
    layout = _layout(usable, n_states, cis_shape, trans_shape, states, seed, init, fixed)
    objective = PixelObjective(pixels, usable, genome, n_states, zeros=zeros, total_zeros=zero_total or 0,
                               value=value)
    return _run(objective, layout, genome, options, 0.0, None, checkpoint, restore, debug)


def fit_decay(pixels: DataFrame, bins: DataFrame, genome: Genome, resolution: float = 1.0,
              options: dict | None = None, value: str = "count") -> tuple[float, float, Result]:
    """Fit the decay power and the trans constant alone (one state, weights fixed)."""
    half = np.full((genome.n_bins, 1), 0.5)
    fit = fit_dense(pixels, bins, genome, 1, cis_shape="eye", trans_shape="eye",
                    init={"state_probabilities": half}, fixed={"state_probabilities": half},
                    options=options, resolution=resolution, value=value)
    return fit.cis_dd_power, fit.trans_dd, fit.result


def seeds_for(iterations: int, seeds: Sequence[int], zero_seeds: Sequence[int] | None = None
              ) -> list[tuple[int | None, int | None]]:
    """(start seed, zero-sample seed) per iteration; missing ones are not seeded."""
    if len(seeds) > iterations or len(zero_seeds or ()) > iterations:
        raise ValueError("more seeds than iterations")
    first = list(seeds) + [None] * (iterations - len(seeds))
    if zero_seeds is None:
        return list(zip(first, first))
    return list(zip(first, list(zero_seeds) + [None] * (iterations - len(zero_seeds))))


def best_of(run: Callable[[int | None, int | None, int], Fit], iterations: int, seeds: Sequence[int] = (),
            zero_seeds: Sequence[int] | None = None) -> Fit:
    """Repeat a fit from different starts and keep the lowest objective (the first
    one on ties).  ``run`` gets the two seeds and the iteration number."""
    best: Fit | None = None
    durations = []
    for number, (seed, zero_seed) in enumerate(seeds_for(iterations, seeds, zero_seeds), start=1):
        began = time.time()
        fit = run(seed, zero_seed, number)
        durations.append(time.time() - began)
        if best is None or fit.objective < best.objective:
            best = fit
    return replace(best, metadata={**best.metadata, "durations": durations})
