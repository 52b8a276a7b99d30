"""Headline queries, timed: prints one JSON line.

Every query runs its full plan into the no-op sink (nothing is collected or
cached between queries). Derived rates compare with single-thread figures of
about 18,000 scored windows and 44,000 parsed orbit records per second.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from driftline.registry import QUERIES  # noqa: E402
from driftline.registry.base import SUPPLY_ORDER, Tables  # noqa: E402
from driftline.registry.scoring import COEF, WEIGHTS  # noqa: E402
from driftline.plans.monitoring import Flow, frozen, measure  # noqa: E402
from driftline.registry.sources import orbit_lines  # noqa: E402
from driftline.session import local_session, materialise  # noqa: E402
from driftline.sources import text as S  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["E1_first_fire", "F1_time_domain", "F5_correlations", "F9_asteroid_vector", "F20_event_features", "D4_J6_basin_distance",
            "D5_distance_on_line", "C8_precision_recall_sweep", "E2_sustained_fire", "A3_spearman", "A16_two_sample_ks",
            "M3_regime_scaling", "T4_append_dedupe", "P12_fill_gaps"]


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8, "driftline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, FOLDER)
    # start-up: code generation, Python workers and the state of the page cache are no part of any query
    for name in ("E1_first_fire", "F9_asteroid_vector"):
        run(QUERIES[name](spark, FOLDER))
    times: dict[str, float] = {}
    rates: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, FOLDER))
        times[name] = round(time.perf_counter() - start, 3)

    # windows per second: every window (stride 1) of the dense histories
    dense = t.supply().withColumns({"v": F.col("l_quantity"), "k": F.col("l_discount")})
    flow = Flow("l_suppkey", tuple(SUPPLY_ORDER), "day", ("v", "k"), 30, 1, 200.0, 5, rows=t.rows("lineitem"))
    start = time.perf_counter()
    windows = materialise(flow.windows(dense))
    times["dense_windows"] = round(time.perf_counter() - start, 3)
    n = windows.count()
    rates["windows_per_sec"] = round(n / times["dense_windows"])
    start = time.perf_counter()
    run(measure(windows, frozen(windows, COEF, WEIGHTS), F.col("label") == 1, 5))
    times["dense_scoring"] = round(time.perf_counter() - start, 3)
    rates["scored_windows_per_sec"] = round(n / times["dense_scoring"])

    # records per second of the orbit text parser, text staged beforehand
    staged = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/orbits"
    lines = orbit_lines(t).repartition(8)
    lines.select(F.concat_ws("\n", "line1", "line2").alias("value")).write.text(staged)
    start = time.perf_counter()
    run(S.parse_orbits(S.read_orbit_pairs(spark, staged)))
    times["orbit_text"] = round(time.perf_counter() - start, 3)
    rates["orbit_records_per_sec"] = round(t.rows("lineitem") / times["orbit_text"])

    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "rates": rates, "n_windows": n, "sf": Path(FOLDER).name.replace("sf", "")}))


if __name__ == "__main__":
    main()
