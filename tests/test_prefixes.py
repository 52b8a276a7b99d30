"""Growing prefixes: rank correlations without re-ranking, and features equal to those of the prefix as an event of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.catalog.features import CONJUNCTION_CONSISTENT
from driftline.operators import prefix_ranks
from driftline.plans import conjunction


def ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def brute(a, b):
    out = []
    for k in range(1, len(a) + 1):
        x, y = ranks(a[:k]), ranks(b[:k])
        out.append(0.0 if k < 3 or x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1])
    return np.array(out)


@pytest.mark.parametrize("levels", [1, 2, 7, 10 ** 6])
@pytest.mark.parametrize("block", [1, 3, 16, None])
def test_prefix_rhos(levels, block):
    rng = np.random.default_rng(levels)
    for n in (1, 2, 3, 40, 90):
        a, b = rng.integers(0, levels, n).astype(float), rng.integers(0, levels, n).astype(float)
        assert np.allclose(prefix_ranks.prefix_rhos(a, b, block), brute(a, b), atol=1e-12)
        assert np.allclose(prefix_ranks._short(a[None], b[None])[0], brute(a, b), atol=1e-12)


def test_objects_over_batches(spark):
    """Objects of any length in small batches, unknown values, a null key."""
    rng = np.random.default_rng(8)
    rows = [(None if o == 4 else o, p, None if rng.random() < 0.1 else float(rng.integers(0, 9)), float("nan") if rng.random() < 0.1 else float(rng.random()))
            for o, n in enumerate((1, 5, 70, 0, 33, 32, 2)) for p in range(n)]
    df = spark.createDataFrame(rows, "obj long, pos long, x double, y double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r.obj, r.pos): r.rho for r in prefix_ranks.prefix_correlation(df, ["obj"], "pos", "x", "y").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expect = {}
    for o in {r[0] for r in rows}:
        some = [r for r in rows if r[0] == o and r[2] is not None and r[3] == r[3]]
        expect |= {(o, r[1]): v for r, v in zip(some, brute(np.array([r[2] for r in some]), np.array([r[3] for r in some])))}
    assert got.keys() == expect.keys() and all(abs(got[k] - expect[k]) < 1e-12 for k in got)


NAMES = ["risk", "miss_distance", "mahalanobis_distance", "relative_position_r", "relative_position_t", "relative_position_n", "t_sigma_r", "c_sigma_r", "t_position_covariance_det",
         "c_position_covariance_det", "t_obs_used", "c_obs_used", "t_weighted_rms", "c_weighted_rms", "c_actual_od_span", "t_time_lastob_end", "c_time_lastob_end"]


@pytest.mark.parametrize("limit", [2_000_000, 6])
def test_features_are_those_of_the_prefix(spark, limit):
    """Every prefix as an event of its own, through the features of whole events; also with events cut into pieces."""
    rng = np.random.default_rng(5)
    value = lambda: None if rng.random() < 0.15 else float(np.round(rng.normal(), 1))
    rows = [(e, float(np.round(2.2 - 2 * p / n, 3)), p, *[value() for _ in NAMES]) for e, n in ((1, 4), (2, 5), (3, 9), (4, 23)) for p in range(n)]
    df = spark.createDataFrame(rows, "event_id long, time_to_tca double, no long, " + ", ".join(f"{c} double" for c in NAMES))
    got = {(r.event_id, r.step): r for r in conjunction.prefix_features(df, tie=["no"], limit=limit).collect()}
    near = [r for r in rows if r[1] <= 2]
    sizes = {e: sum(r[0] == e for r in near) for e in (1, 2, 3, 4)}
    parts = [(e * 1000 + k, *r[1:]) for e, n in sizes.items() if n >= 5 for k in range(2, n + 1) for r in sorted((r for r in near if r[0] == e), key=lambda r: -r[1])[:k]]
    whole = conjunction.event_features(spark.createDataFrame(parts, df.schema), tie=["no"]).collect()
    assert len(whole) == len(got) > 25
    for w in whole:
        g = got[divmod(w.event_id, 1000)]
        for c in CONJUNCTION_CONSISTENT:
            assert (w[c] is None) == (g[c] is None) and (w[c] is None or abs(w[c] - g[c]) <= 1e-7 * max(1, abs(w[c]))), (w.event_id, c, w[c], g[c])
