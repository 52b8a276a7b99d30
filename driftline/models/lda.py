"""Supervised projection to one dimension.

The data-sized part is one pass that reduces every class to its count, mean and
covariance; the driver only sees d × d matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.models.moments import Packed, feature_columns, feature_matrix, packed_sums
from driftline.models.scale import Stats, fit_stats, zscore
from driftline.session import materialise


def _unit(stats: tuple[float, float]) -> tuple[float, float]:
    """Mean and divisor of a column; a constant one is only centred."""
    return float(stats[0]), float(stats[1]) if stats[1] else 1.0


def _standard(x: np.ndarray, mean: float | np.ndarray, std: float | np.ndarray) -> np.ndarray:
    """(x - mean) / std with undefined values set to 0."""
    with np.errstate(all="ignore"):
        z = (x - mean) / std
    return np.where(np.isfinite(z), z, 0.0)


@dataclass
class Projection:
    """Everything scoring needs: per feature mean, deviation, weight and coefficient, plus an offset."""

    features: list[str]
    stats: Stats
    weights: dict[str, float]
    coef: dict[str, float]
    offset: float = 0.0
    condition: float | None = None
    packed: Packed | None = None

    def column(self, dropped: Sequence[str] = ()) -> Column:
        """The projection as one expression; `dropped` features get weight 0. Undefined values count as 0.

        Columns are added up as arrays: one built-in expression of dozens of features is too long a method for the JVM to compile.
        """
        used = [f for f in self.features if f not in dropped]
        if not used:
            return F.lit(-self.offset)
        units = [_unit(self.stats[f]) for f in used]
        factors, start = [float(self.weights.get(f, 1.0) * self.coef[f]) for f in used], -self.offset

        def added(columns, count: int) -> np.ndarray:
            out = np.full(count, start)
            for c, unit, factor in zip(columns, units, factors):
                out += _standard(c, *unit) * factor
            return out

        if self.packed:
            matrix = feature_matrix(used, self.packed)

            @F.arrow_udf("double")
            def project_packed(rows: pa.Array) -> pa.Array:
                return pa.array(added(matrix([rows]).T, len(rows)))

            return project_packed(*feature_columns(used, self.packed))

        @F.pandas_udf("double")
        def project(*columns: pd.Series) -> pd.Series:
            return pd.Series(added((c.to_numpy(dtype=float, na_value=np.nan) for c in columns), len(columns[0])))

        return project(*[F.col(f).cast("double") for f in used])

    def score(self, df: DataFrame, name: str = "proj") -> DataFrame:
        return df.withColumn(name, self.column())

    def written(self, df: DataFrame, name: str = "proj") -> DataFrame:
        """`score` without the features, written once: a search reads the projections many times."""
        return materialise(self.score(df, name).drop(*([self.packed.column] if self.packed else self.features)))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f, *map(float, self.stats[f]), float(self.weights.get(f, 1.0)), float(self.coef[f]))
                for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "idx int, feature string, mean double, std double, weight double, coef double")


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="v").transform(df).select("v")


@dataclass
class Moments:
    """Row count, mean and covariance (population) of one class."""

    n: int
    mean: np.ndarray
    cov: np.ndarray


Change = Callable[[np.ndarray], np.ndarray]


def class_moments(z: DataFrame, features: Sequence[str], label: str, change: Change | None = None, packed: Packed | None = None) -> dict[int, Moments]:
    """Moments of every class in one pass; the driver receives one triangle of products per class.

    Columns should be standardised, which keeps the sums well conditioned, or `change` does it (see `preparing`).
    """
    d = len(features)
    rows = z.select(*([packed.column] if packed else features), F.col(label).cast("int").alias("_label")).where("_label IS NOT NULL")
    table = packed_sums(rows, ["_label"], features, change, packed).toArrow()
    labels, parts, counts, slices = (table.column(c).combine_chunks() for c in ("_label", "_part", "_n", "_s"))
    at = sorted(range(len(labels)), key=lambda i: (labels[i].as_py(), parts[i].as_py()))
    found: dict[int, tuple[int, list]] = {}
    for i in at:
        found.setdefault(labels[i].as_py(), (counts[i].as_py(), []))[1].append(slices[i].values.to_numpy())
    out = {}
    for c, (n, arrays) in found.items():
        whole = np.concatenate(arrays)
        mean, g = whole[:d] / n, np.zeros((d, d))
        g[np.triu_indices(d)] = whole[d:]
        out[c] = Moments(n, mean, (g + np.triu(g, 1).T) / n - np.outer(mean, mean))
    return out


def _fourth_moments(z: DataFrame, features: Sequence[str], label: str, of: dict[int, Moments], change: Change, packed: Packed | None = None) -> dict[int, float]:
    """Mean squared squared norm of the rows, each standardised within its class."""
    matrix = feature_matrix(features, packed)
    shift = {c: m.mean for c, m in of.items()}
    stretch = {c: _deviations(m) for c, m in of.items()}

    def norms(batches):
        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = change(matrix(b.columns[:-1]))
            y = b.columns[-1].to_numpy(zero_copy_only=False)
            for c in np.unique(y):
                u = (x[y == c] - shift[int(c)]) / stretch[int(c)]
                total[int(c)] = total.get(int(c), 0.0) + float(((u * u).sum(axis=1) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())],
                                         names=["label", "q"])

    rows = z.select(*feature_columns(features, packed), F.col(label).cast("int").alias("_label")).where("_label IS NOT NULL")
    sums = rows.mapInArrow(norms, "label int, q double").groupBy("label").agg(F.sum("q").alias("q")).collect()
    return {r["label"]: r["q"] / of[r["label"]].n for r in sums}


def _deviations(m: Moments) -> np.ndarray:
    dev = np.sqrt(np.maximum(np.diag(m.cov), 0.0))
    return np.where(dev > 1e-12, dev, 1.0)


def shrinkage_intensity(second: np.ndarray, fourth: float, n: int) -> float:
    """Ledoit–Wolf intensity from the covariance and the mean of the squared row norms squared."""
    p = len(second)
    mu = np.trace(second) / p
    delta_raw = float((second ** 2).sum())
    beta = (fourth - delta_raw) / (p * n)
    delta = (delta_raw - 2.0 * mu * np.trace(second) + p * mu * mu) / p
    beta = min(beta, delta)
    return 0.0 if beta <= 0 else beta / delta


def prepare(df: DataFrame, features: Sequence[str], stats: Stats, weights: Mapping[str, float]) -> DataFrame:
    """Standardised, weighted columns with undefined values set to 0."""
    out = {}
    for f in features:
        z = zscore(f, *stats[f])
        out[f] = F.when(F.isnan(z) | (F.abs(z) == float("inf")) | z.isNull(), 0.0).otherwise(z) * F.lit(
            float(weights.get(f, 1.0)))
    return df.withColumns(out)


def preparing(features: Sequence[str], stats: Stats, weights: Mapping[str, float]) -> Change:
    """`prepare` for a matrix of the features' columns inside a task."""
    mean, std = (np.array(c) for c in zip(*[_unit(stats[f]) for f in features]))
    factor = np.array([float(weights.get(f, 1.0)) for f in features])
    return lambda x: _standard(x, mean, std) * factor


def fit_two_class(df: DataFrame, features: Sequence[str], label: str, weights: Mapping[str, float] | None = None,
                  stats: Stats | None = None) -> Projection:
    """Two-class discriminant: pseudo-inverse of the within-class scatter times the mean difference.

    Scaled so that the pooled within-class variance of the projection is 1; the
    sign puts class 1 above class 0.
    """
    weights = dict(weights or {})
    stats = stats or fit_stats(df, features)
    of = class_moments(df, features, label, preparing(features, stats, weights))
    n = of[0].n + of[1].n
    within = (of[0].n * of[0].cov + of[1].n * of[1].cov) / (n - 2)
    diff = of[1].mean - of[0].mean
    coef = np.linalg.pinv(within, rcond=1e-9, hermitian=True) @ diff
    norm = float(np.sqrt(coef @ within @ coef)) or 1.0
    coef = coef / norm
    centre = float((of[0].n * of[0].mean + of[1].n * of[1].mean) / n @ coef)
    eig = np.linalg.eigvalsh(within)
    cond = float(eig[-1] / max(eig[0], 1e-300))
    return Projection(list(features), stats, weights, dict(zip(features, map(float, coef))), centre, cond)


def fit_buckets(df: DataFrame, features: Sequence[str], label: str, weights: Mapping[str, float] | None = None,
                stats: Stats | None = None, basin_class: int = 0, packed: Packed | None = None) -> Projection:
    """First discriminant of several ordered classes, with shrunk class covariances.

    The sign puts `basin_class` above the mean of the others. Features in one array column (`packed`) need their `stats`.
    """
    weights = dict(weights or {})
    stats = stats or fit_stats(df, features)
    change = preparing(features, stats, weights)
    of = class_moments(df, features, label, change, packed)
    fourth = _fourth_moments(df, features, label, of, change, packed)
    d, n = len(features), sum(m.n for m in of.values())
    grand = sum(m.n * m.mean for m in of.values()) / n
    within, between = np.zeros((d, d)), np.zeros((d, d))
    for c, m in of.items():
        away = m.mean - grand
        between += m.n / n * np.outer(away, away)
        if m.n < 2:
            continue                                    # a single row has no scatter
        dev = _deviations(m)
        unit = m.cov / np.outer(dev, dev)
        s = shrinkage_intensity(unit, fourth[c], m.n)
        within += m.n / n * ((1 - s) * unit + s * np.trace(unit) / d * np.eye(d)) * np.outer(dev, dev)
    low = np.linalg.cholesky(within + 1e-12 * np.trace(within) / d * np.eye(d))
    half = np.linalg.solve(low, np.linalg.solve(low, between).T)
    vec = np.linalg.solve(low.T, np.linalg.eigh((half + half.T) / 2)[1][:, -1])
    at = basin_class if basin_class in of else min(of)
    if (of[at].mean - grand) @ vec < 0:
        vec = -vec
    return Projection(list(features), stats, weights, dict(zip(features, map(float, vec))), float(grand @ vec), packed=packed)


def loadings(model: Projection, spark: SparkSession) -> DataFrame:
    return model.table(spark).select("feature", "coef", F.abs("coef").alias("abs_coef"))


def loading_shares(coefs: DataFrame, catalogue: DataFrame, by: str) -> DataFrame:
    """Absolute loading summed by channel or feature class, with its share of the total."""
    sums = coefs.join(F.broadcast(catalogue), "feature").groupBy(F.coalesce(F.col(by), F.lit("_covariance")).alias(by)).agg(
        F.sum(F.abs("coef")).alias("loading"))
    total = sums.agg(F.sum("loading").alias("_t")).withColumn("_one", F.lit(1))
    out = sums.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return out.select(by, "loading", (F.lit(100.0) * F.col("loading") / F.greatest("_t", F.lit(1e-10))).alias("pct"))


def fit_pca(df: DataFrame, features: Sequence[str], dims: int = 64) -> tuple[PCAModel, dict[str, float]]:
    """Principal components of the centred columns."""
    means = {f: m for f, (m, _) in fit_stats(df, features).items()}
    centred = df.withColumns({f: F.col(f) - F.lit(means[f]) for f in features})
    return PCA(k=min(dims, len(features)), inputCol="v", outputCol="embedding").fit(_vectors(centred, features)), means


def project_pca(df: DataFrame, model: PCAModel, means: Mapping[str, float]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    shifted = df.withColumns({f"_c_{f}": F.col(f) - F.lit(m) for f, m in means.items()})
    vec = VectorAssembler(inputCols=[f"_c_{f}" for f in means], outputCol="v").transform(shifted)
    out = model.transform(vec).withColumn("embedding", vector_to_array("embedding"))
    return out.drop("v", *[f"_c_{f}" for f in means])
