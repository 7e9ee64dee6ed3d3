"""Command line: fit, stretch, downsample, resample, best, datafile."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import key_values, number
from ..genome import Genome
from ..model.checkpoint import OptimiserCheckpoint
from ..model.fit import Fit, best_of, fit_dense, fit_sparse
from ..model.generate import ModelMatrix
from ..model.mass import Model
from ..operators.balance import balance, balanced_by_coefficients
from ..operators.clean import marginal_filter
from ..operators.reshape import select_fit, stretched
from ..operators.select import balanced, select_bins, select_chroms
from ..operators.sampling import downsampled, multinomial, read_total
from ..sources import fits
from ..sources.cool import read_cool
from ..sources.dense import model_input, read_npy
from ..sources.registry import top_fits
from ..sources.store import ContactStore, detect_kind


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plaidframe")
    sub = top.add_subparsers(dest="command", required=True)

    fit = sub.add_parser("fit", help="fit the compartment model")
    fit.add_argument("-m", dest="source", required=True)
    fit.add_argument("-t", dest="kind", choices=["store", "mcool", "numpy", "auto"], default="auto")
    fit.add_argument("-o", dest="output", default="fit_out")
    fit.add_argument("-ch", dest="chroms", default=None)
    fit.add_argument("-kb", dest="resolution", type=int, default=None)
    fit.add_argument("-n", dest="states", type=int, default=2)
    fit.add_argument("-s", dest="shape", default="symmetric,symmetric")
    fit.add_argument("--iterations", type=int, default=10)
    fit.add_argument("--seed", type=int, nargs="+", default=[])
    fit.add_argument("--zero-sample-seed", type=int, nargs="+", default=None)
    fit.add_argument("--sparse", action="store_true")
    fit.add_argument("--zero-sample", type=int, default=None)
    fit.add_argument("-b", dest="balance", action="store_true")
    fit.add_argument("--init", default=None)
    fit.add_argument("--init-stretch-by", type=int, default=1)
    fit.add_argument("--optimize-args", default="")
    fit.add_argument("--kwargs", default="")
    fit.add_argument("--matrix-kwargs", default="")
    fit.add_argument("--transonly", action="store_true")
    fit.add_argument("--disable-checkpoint", action="store_true")
    fit.add_argument("--checkpoint-file", default="{output}_{iteration}.ckpt")
    fit.add_argument("--checkpoint-keep", action="store_true")
    fit.add_argument("--disable-checkpoint-restore", action="store_true")
    fit.add_argument("--no-overwrite", action="store_true")

    stretch = sub.add_parser("stretch", help="carry a fit over to a finer resolution")
    stretch.add_argument("-f", dest="fit", required=True)
    stretch.add_argument("-r", dest="ratio", type=int, required=True)
    stretch.add_argument("-o", dest="output", required=True)
    stretch.add_argument("-m", dest="source", default=None)
    stretch.add_argument("-kb", dest="resolution", type=int, default=None)
    stretch.add_argument("-ch", dest="chroms", default="all")

    down = sub.add_parser("downsample", help="keep a part of the reads")
    down.add_argument("-m", dest="source", required=True)
    down.add_argument("-c", dest="chroms", default="all")
    down.add_argument("-r", dest="resolution", type=int, default=None)
    down.add_argument("-o", dest="output", required=True)
    down.add_argument("-s", dest="samples", type=number, required=True)
    down.add_argument("--seed", type=int, default=0)
    down.add_argument("--balance", choices=["yes", "no"], default="yes")

    res = sub.add_parser("resample", help="draw reads from a fit")
    res.add_argument("-f", dest="fit", required=True)
    res.add_argument("--reads", type=number, required=True)
    res.add_argument("-m", dest="source", default=None)
    res.add_argument("-c", dest="chroms", default="all")
    res.add_argument("-r", dest="resolution", type=int, default=None)
    res.add_argument("--fit-chrs", default="")
    res.add_argument("-o", dest="output", required=True)
    res.add_argument("--seed", type=int, default=0)
    res.add_argument("--balance", choices=["yes", "no", "weights"], default="yes")

    best = sub.add_parser("best", help="list the best stored fits")
    best.add_argument("fits", nargs="+")
    best.add_argument("-n", type=int, default=1)
    best.add_argument("--no-recursive", dest="recursive", action="store_false")
    best.add_argument("-t", "--target", default=None, help="copy the fits here; {n} is the rank")

    data = sub.add_parser("datafile", help="show or change the metadata of a fit")
    data.add_argument("fit")
    data.add_argument("--set", dest="changes", default="")
    data.add_argument("--output", default=None)
    data.add_argument("--dry-run", action="store_true")
    data.add_argument("--parameters", action="store_true")
    return top


def _source(spark: SparkSession, args, balance=None):
    """Pixels, bins and genome of the data the arguments name."""
    kind = detect_kind(args.source) if getattr(args, "kind", "auto") == "auto" else args.kind
    spec = (args.chroms or "all").split(",")
    if kind == "numpy":
        cells, n = read_npy(spark, args.source)
        pixels, bins = model_input(cells, n)
        return pixels, bins, Genome.single(n, args.resolution or 1)
    if kind == "mcool":
        if args.chroms is None or args.resolution is None:
            raise SystemExit("chromosomes and resolution are required for this source")
        pixels, bins, genome = read_cool(spark, args.source, args.resolution)
        if balance:
            pixels = balanced(pixels, bins, genome.n_bins).select("bin1_id", "bin2_id", F.col("balanced").alias("count"))
        positions = genome.pick(*spec)
        return (select_chroms(pixels, genome, *spec, trans_only=getattr(args, "transonly", False)),
                select_bins(bins, genome, *[genome.names[k] for k in positions]), genome.subset(positions))
    store = ContactStore(spark, args.source)
    return store.read(*spec, resolution=args.resolution, balance=balance or False,
                      trans_only=getattr(args, "transonly", False))


def run_fit(spark: SparkSession, args) -> Fit | None:
    path = args.output
    if args.no_overwrite and OptimiserCheckpoint(spark, f"{path}/fit").exists():
        print(f"{path} exists, nothing to do")
        return None
    options = key_values(args.matrix_kwargs)
    pixels, bins, genome = _source(spark, args, options.get("balance", "weight"))
    if args.balance:
        even = balance(pixels.withColumnRenamed("count", "value"), genome.n_bins)
        pixels = even.where("bin1_id <= bin2_id").withColumnRenamed("balanced", "count")
    cis_shape, _, trans_shape = args.shape.partition(",")
    init = None
    if args.init:
        start = fits.load(spark, args.init)
        if args.init_stretch_by > 1:
            good = bins.where("weight is not null").select("bin_id")
            states, _ = stretched(start.states_frame(spark), start.genome, args.init_stretch_by, genome, good,
                                  start.n_states)
            start = replace(start, state_probabilities=_as_array(states, genome.n_bins, start.n_states), genome=genome)
        init = start.start_values()
    shared = dict(cis_shape=cis_shape, trans_shape=trans_shape or cis_shape, init=init,
                  options=key_values(args.optimize_args), restore=not args.disable_checkpoint_restore,
                  **key_values(args.kwargs))

    def one(seed, zero_seed, number) -> Fit:
        ckpt = None
        if not args.disable_checkpoint:
            ckpt = OptimiserCheckpoint(spark, args.checkpoint_file.format(output=path, iteration=number))
        if args.sparse:
            return fit_sparse(pixels, bins, genome, args.states, n_zeros=args.zero_sample, seed=seed,
                              zero_seed=zero_seed or 0, checkpoint=ckpt, **shared)
        return fit_dense(pixels, bins, genome, args.states, seed=seed, resolution=genome.resolution,
                         checkpoint=ckpt, **shared)

    best = best_of(one, args.iterations, args.seed, args.zero_sample_seed)
    fits.save(spark, path, best, {"args": {k: str(v) for k, v in vars(args).items()}}, mode="overwrite")
    if not (args.disable_checkpoint or args.checkpoint_keep):
        for number in range(1, args.iterations + 1):
            OptimiserCheckpoint(spark, args.checkpoint_file.format(output=path, iteration=number)).remove()
    print(f"objective {best.objective:.6f} saved to {path}")
    return best


def _as_array(states, n_bins: int, n_states: int):
    out = np.full((n_bins, n_states), np.nan)
    for row in states.where("probs is not null").toLocalIterator():
        out[row["bin_id"]] = row["probs"]
    return out


def run_stretch(spark: SparkSession, args) -> None:
    fit = fits.load(spark, args.fit)
    target = usable = None
    if args.source:
        store = ContactStore(spark, args.source)
        _, bins, target = store.read(*args.chroms.split(","), resolution=args.resolution, balance=False)
        usable = bins.where("weight is not null").select("bin_id")
    states, genome = stretched(fit.states_frame(spark), fit.genome, args.ratio, target, usable, fit.n_states)
    meta = {"stretched_from": fit.metadata, "ratio": args.ratio}
    fits.save(spark, args.output, replace(fit, genome=genome, metadata=meta), mode="overwrite", states=states)


def thinned_bins(thin: DataFrame, bins: DataFrame, balanced_now: bool) -> DataFrame:
    """Bin table of a thinned matrix: the old weights do not fit its counts any more.

    Usable bins get weight 1, since the stored counts are to be read as they are; after
    balancing, bins that the marginal filter removed are unusable.
    """
    even = F.when(F.col("weight").isNotNull(), F.lit(1.0))
    if not balanced_now:
        return bins.withColumn("weight", even)
    left = thin.where("count is not null").select(F.explode(F.array("bin1_id", "bin2_id")).alias("bin_id")).distinct()
    return (bins.join(left.withColumn("__left", F.lit(True)), "bin_id", "left")
            .withColumn("weight", F.when(F.col("__left"), even)).drop("__left"))


def run_downsample(spark: SparkSession, args) -> None:
    pixels, bins, genome = _source(spark, args, False)
    thin = downsampled(pixels, args.samples, args.seed)
    if args.balance == "yes":
        kept = marginal_filter(thin, genome.n_bins).where("count is not null")
        thin = (balance(kept.withColumn("value", F.col("count").cast("double")).drop("count"), genome.n_bins)
                .where("bin1_id <= bin2_id").withColumnRenamed("balanced", "count"))
    bins = thinned_bins(thin, bins, args.balance == "yes")
    ContactStore(spark, args.output).write(thin, bins, genome, args.resolution, mode="overwrite")


def run_resample(spark: SparkSession, args) -> None:
    fit = fits.load(spark, args.fit)
    states, genome = fit.states_frame(spark), fit.genome
    if args.fit_chrs:
        states, genome = select_fit(states, genome, [int(k) for k in args.fit_chrs.split(",")])
    data = _source(spark, args, False) if args.source else None
    reads = args.reads
    if isinstance(reads, float):
        if data is None:
            raise SystemExit("a share of reads needs the data it refers to")
        if not 0 <= reads <= 1:
            raise SystemExit("a share of reads must lie between 0 and 1")
        reads = int(read_total(data[0], data[1], data[2].n_bins, reads).first()["reads"])
    if reads < 0:
        raise SystemExit("the number of reads must not be negative")
    model = Model(states, genome, fit.cis_weights, fit.trans_weights, fit.cis_dd_power, fit.trans_dd)
    drawn = multinomial(ModelMatrix(model).values(), reads, seed=args.seed)
    if args.balance == "yes":
        drawn = (balance(drawn.withColumn("value", F.col("count").cast("double")).drop("count"), genome.n_bins)
                 .where("bin1_id <= bin2_id").withColumnRenamed("balanced", "count"))
    elif args.balance == "weights":
        if data is None:
            raise SystemExit("balancing by weights needs the data they come from")
        weights = data[1].select("bin_id", F.col("weight").alias("coefficient"))
        drawn = (balanced_by_coefficients(drawn.withColumn("value", F.col("count").cast("double")), weights,
                                          genome.n_bins)
                 .select("bin1_id", "bin2_id", F.col("value").alias("count")))
    usable = states.select("bin_id", F.when(F.col("probs").isNotNull(), F.lit(1.0)).alias("weight"))
    b = F.col("bin_id")
    bins = usable.select("bin_id", genome.chrom_of(b).alias("chrom_idx"),
                         genome.per_chrom(b, list(genome.names)).alias("chrom"), "weight")
    ContactStore(spark, args.output).write(drawn, bins, genome, mode="overwrite")


def run_best(spark: SparkSession, args) -> list[str]:
    listed = fits.registry(spark, args.fits, args.recursive)
    rows = top_fits(listed, args.n, order="fit_id").join(listed.select("fit_id", "path"), "fit_id").orderBy("rank").collect()
    print(f"Top {args.n} fits:")
    for row in rows:
        print(row["path"])
        if args.target:
            target = args.target.format(n=row["rank"])
            if OptimiserCheckpoint(spark, f"{target}/fit").exists():
                print(f"{target} exists, skipping")
            else:
                fits.save(spark, target, fits.load(spark, row["path"]))
    return [row["path"] for row in rows]


def run_datafile(spark: SparkSession, args) -> dict:
    if args.changes:
        meta = fits.update_metadata(spark, args.fit, key_values(args.changes), args.output, args.dry_run)
    else:
        meta = fits.metadata(spark, args.fit)
    print(json.dumps(meta, indent=2, default=str))
    if args.parameters:
        spark.read.parquet(f"{args.fit}/fit").drop("metadata").show(truncate=False)
        spark.read.parquet(f"{args.fit}/weights").show()
        fits.states(spark, args.fit).show()
    return meta


COMMANDS = {"fit": run_fit, "stretch": run_stretch, "downsample": run_downsample, "resample": run_resample,
            "best": run_best, "datafile": run_datafile}


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plaidframe").getOrCreate()
    began = time.time()
    out = COMMANDS[args.command](spark, args)
    print(f"{args.command} took {time.time() - began:.1f}s")
    return out


if __name__ == "__main__":
    main()
