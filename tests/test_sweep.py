"""The sweep over widths, basins and neighbours builds its windows once per width."""

from driftline.plans.monitoring import Flow
from driftline.registry import QUERIES, scoring


def test_windows_are_built_once_per_width(spark, monkeypatch):
    built, windows = [], Flow.windows
    monkeypatch.setattr(Flow, "windows", lambda self, df: built.append(self.width) or windows(self, df))
    assert len(QUERIES["C10_parameter_sweep"](spark, "/root/testdata/sf0.001").collect()) == len(scoring.SWEEP)
    assert sorted(built) == [20, 30]
