"""What the stateful processors read, keep and give per object and micro-batch, without a session."""

import numpy as np
import pandas as pd
import pytest

from driftline.streaming import monitor as M


class _Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class _Handle:
    def __init__(self):
        self.values = []

    def getValueState(self, name, schema):
        self.values.append(_Value())
        return self.values[-1]


def test_one_read_and_one_write_of_state_per_object(monkeypatch):
    """Windows of a micro-batch are worked out in slabs, late records one by one; state is read and written once per object and micro-batch."""
    monkeypatch.setattr(M, "_SLAB", 7)
    rng = np.random.default_rng(3)
    names = [f"{c}_{n}" for c in "ab" for n in M.WINDOW_NAMES]
    task, handle = M._Windows("o", "t", ["a", "b"], 5), _Handle()
    task.init(handle)
    first = pd.DataFrame({"t": np.arange(40.0), "a": rng.normal(size=40), "b": rng.normal(size=40)})
    second = pd.DataFrame({"t": [37.5, 1.0, 41.0, 40.0], "a": rng.normal(size=4), "b": rng.normal(size=4)})
    out = [pd.concat(task.handleInputRows((9,), iter(parts), None), ignore_index=True) for parts in ([first[20:], first[:20]], [second])]
    assert [v.calls for v in handle.values] == [4]
    every = pd.concat([first, second[second.t != 1.0]]).sort_values("t")
    late = every[every.t < 40].tail(5)
    ends = [*[first[k:k + 5] for k in range(36)], late, every[every.t <= 40].tail(5), every.tail(5)]
    got = pd.concat(out, ignore_index=True)
    got[names] = np.stack(got["_values"])
    got = got.drop(columns="_values")
    assert got.win.tolist() == list(range(39)) and got.late.tolist() == [False] * 36 + [True, False, False] and got.dropped.tolist() == [0] * 36 + [1] * 3
    for row, w in zip(got.itertuples(), ends):
        assert row.t_end == w.t.iloc[-1]
        for c in "ab":
            x = w[c].to_numpy()
            expect = {"mean": x.mean(), "std": x.std(), "min": x.min(), "max": x.max(), "d1_mean": np.diff(x).mean(), "d1_std": np.diff(x).std(), "d2_mean": np.diff(x, n=2).mean(),
                      "slope": np.polyfit(np.arange(5), x, 1)[0], "ratio": x[2:].mean() / (abs(x[:2].mean()) + 1e-10)}
            assert {n: getattr(row, f"{c}_{n}") for n in expect} == pytest.approx(expect)
    alerts, handle = M._Sustained("win", "f", "t", 3, ["o", "win", "t"]), _Handle()
    alerts.init(handle)
    fired = [True] * 2 + [False] + [True] * 4 + [False, True, True]
    frames = [pd.DataFrame({"win": np.arange(k, k + len(f)), "f": f, "t": np.arange(k, k + len(f)) / 2}) for k, f in ((0, fired), (10, [True, True, False]), (13, [True] * 3))]
    hits = [r for f in frames for part in alerts.handleInputRows((9,), iter([f]), None) for r in part.itertuples(index=False, name=None)]
    assert hits == [(9, 5, 2.5), (9, 10, 5.0), (9, 15, 7.5)] and [v.calls for v in handle.values] == [6]
