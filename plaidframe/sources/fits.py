"""Fits on storage: a folder with the state table, the weights and one row of scalars."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..genome import Genome
from ..model.fit import Fit

# Names a fit must have, and the only optional one.
REQUIRED = ("state_probabilities", "cis_weights", "trans_weights", "cis_dd_power", "trans_dd")
OPTIONAL = ("cis_lengths",)
FIT_SCHEMA = ("cis_dd_power double, trans_dd double, resolution int, chroms array<string>, "
              "cis_lengths array<int>, optimize_value double, metadata string")


def checked(parameters: Mapping) -> dict:
    """Parameters with exactly the known names; an old single ``state_weights`` matrix
    stands for both weight matrices and missing lengths mean one chromosome."""
    out = dict(parameters)
    if "state_weights" in out:
        shared = out.pop("state_weights")
        out.setdefault("cis_weights", shared)
        out.setdefault("trans_weights", shared)
    missing = [k for k in REQUIRED if k not in out]
    unknown = [k for k in out if k not in REQUIRED + OPTIONAL]
    if missing or unknown:
        raise ValueError(f"missing parameters {missing}, unknown parameters {unknown}")
    out.setdefault("cis_lengths", None)
    return out


def from_parameters(parameters: Mapping, metadata: Mapping | None = None) -> Fit:
    p = checked(parameters)
    states = np.asarray(p["state_probabilities"], float)
    lengths = p["cis_lengths"] or [len(states)]
    genome = Genome(tuple(f"chr{k + 1}" for k in range(len(lengths))), tuple(int(n) for n in lengths))
    return Fit(states, np.asarray(p["cis_weights"], float), np.asarray(p["trans_weights"], float),
               float(p["cis_dd_power"]), float(p["trans_dd"]), genome, None, dict(metadata or {}))


def save(spark: SparkSession, path: str, fit: Fit, metadata: Mapping | None = None, mode: str = "errorifexists",
         states: DataFrame | None = None) -> None:
    """Write a fit; ``mode='ignore'`` skips existing ones.  ``states`` replaces the
    fit's own state vectors by a distributed table."""
    meta = {**fit.metadata, **(metadata or {})}
    table = states if states is not None else fit.states_frame(spark)
    table.select("bin_id", "probs").write.mode(mode).parquet(f"{path}/states")
    weights = [(kind, s, t, float(w[s, t])) for kind, w in (("cis", fit.cis_weights), ("trans", fit.trans_weights))
               for s in range(len(w)) for t in range(len(w))]
    spark.createDataFrame(weights, "kind string, s1 int, s2 int, w double").coalesce(1).write.mode(mode).parquet(f"{path}/weights")
    _write_scalars(spark, path, fit, meta, mode)


def _write_scalars(spark, path, fit: Fit, meta: dict, mode: str) -> None:
    value = meta.get("optimize_value")
    row = (float(fit.cis_dd_power), float(fit.trans_dd), int(fit.genome.resolution), list(fit.genome.names),
           list(fit.genome.lengths), None if value is None else float(value), json.dumps(meta, default=str))
    spark.createDataFrame([row], FIT_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path}/fit")


def states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/states")


def metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/fit").select("metadata").first()[0])


def load(spark: SparkSession, path: str) -> Fit:
    row = spark.read.parquet(f"{path}/fit").first()
    weights = {}
    for r in spark.read.parquet(f"{path}/weights").collect():  # states squared rows
        weights.setdefault(r["kind"], []).append((r["s1"], r["s2"], r["w"]))
    n = int(round(len(weights["cis"]) ** 0.5))
    matrices = {}
    for kind, entries in weights.items():
        matrices[kind] = np.zeros((n, n))
        for s, t, w in entries:
            matrices[kind][s, t] = w
    genome = Genome(tuple(row["chroms"]), tuple(row["cis_lengths"]), row["resolution"])
    values = np.full((genome.n_bins, n), np.nan)
    for r in states(spark, path).where("probs is not null").toLocalIterator():
        values[r["bin_id"]] = r["probs"]
    return Fit(values, matrices["cis"], matrices["trans"], row["cis_dd_power"], row["trans_dd"], genome, None,
               json.loads(row["metadata"]))


def update_metadata(spark: SparkSession, path: str, changes: Mapping, output: str | None = None,
                    dry_run: bool = False) -> dict:
    """Merge ``changes`` into the metadata, new values first; optionally into a copy."""
    fit = load(spark, path)
    merged = {**fit.metadata, **changes}
    if dry_run:
        return merged
    fit.metadata = merged
    if output and output != path:
        save(spark, output, fit, mode="overwrite")
    else:
        _write_scalars(spark, path, fit, merged, "overwrite")
    return merged


def registry(spark: SparkSession, paths: Iterable[str], recursive: bool = True, field: str = "optimize_value"
             ) -> DataFrame:
    """``(fit_id, path, score)`` of stored fits, numbered in listing order.  A folder of
    fits counts as all fits in it unless ``recursive`` is off."""
    patterns = []
    for p in paths:
        patterns.append(f"{p}/fit")
        if recursive:
            patterns.append(f"{p}/*/fit")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm = spark.sparkContext._jvm
    found = []
    for pattern in patterns:
        hpath = jvm.org.apache.hadoop.fs.Path(pattern)
        hits = hpath.getFileSystem(conf).globStatus(hpath) or []
        found += sorted(h.getPath().toString() for h in hits)
    if not found:
        return spark.createDataFrame([], "fit_id int, path string, optimize_value double")
    order = spark.createDataFrame([(k, p[: -len("/fit")]) for k, p in enumerate(dict.fromkeys(found))],
                                  "fit_id int, path string")
    score = F.get_json_object("metadata", f"$.{field}").cast("double")
    rows = (spark.read.schema(FIT_SCHEMA).parquet(*dict.fromkeys(found))
            .select(F.regexp_replace("_metadata.file_path", r"/fit/[^/]*$", "").alias("path"), score.alias(field)))
    norm = F.regexp_replace("path", "^file:/+", "file:/")
    return (rows.withColumn("__p", norm).drop("path").join(F.broadcast(order.withColumn("__p", norm)), "__p")
            .select("fit_id", "path", field))
