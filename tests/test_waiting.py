import pickle
import random
from types import SimpleNamespace

import pandas as pd
import pytest

from gleanery.streaming import folds, stateful


class _Value:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class _Map(dict):
    most = 0
    getValue, removeKey = dict.__getitem__, dict.__delitem__  # noqa: N815

    def updateValue(self, k, v):  # noqa: N802
        self.most = max(self.most, len(pickle.loads(v[0])))
        self[k] = v


class _Handle:
    """What a processor asks of its state, for one key."""

    def __init__(self):
        self.timers = set()
        self.getValueState = lambda *_: _Value()
        self.getMapState = lambda *_: _Map()
        self.listTimers = lambda: [*self.timers]
        self.registerTimer = self.timers.add


def _run(step, batches, marks):
    """What a step gives of batches of (ts in seconds, event_id, item), the watermark being set after each."""
    handle, out = _Handle(), []
    step.init(handle)
    for batch, mark in zip(batches, marks, strict=True):
        frames = [pd.DataFrame({"ts": pd.to_datetime([x[0] for x in some], unit="s"), "event_id": [x[1] for x in some], "item": [x[2] for x in some]}) for some in batch]
        list(step.handleInputRows(("k",), iter(frames), None))
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m * 1000)
        while due := [t for t in handle.timers if t <= mark * 1000]:
            handle.timers.remove(min(due))
            out += [r for f in step.handleExpiredTimer(("k",), times, None) for r in f.itertuples(index=False, name=None)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_events_wait_in_runs_and_come_in_order(seed, monkeypatch):
    monkeypatch.setattr(stateful, "RUN", 50)
    monkeypatch.setattr(stateful, "PART", 7)
    monkeypatch.setattr(stateful, "SLICE", 11)
    pick = random.Random(seed)
    rows = [(pick.randrange(2000), i, pick.choice("abcdef")) for i in range(600)]
    # each batch in frames of 20; nothing comes later than the watermark before it
    marks = [300, 300, 1100, 3000]
    batches = [[] for _ in marks]
    for r in rows:
        batches[pick.choice([b for b in range(4) if b == 0 or r[0] >= marks[b - 1]])].append(r)
    framed = [[b[i : i + 20] for i in range(0, len(b), 20)] for b in batches]
    step = stateful._Folding(["item"], "evicted", folds.recently_used(3))
    got = _run(step, framed, marks)
    fold, want = folds.recently_used(3), []
    state = fold.start()
    for t, i, item in sorted(rows):
        state, gone = fold.step(state, t * 1_000_000, item)
        want.append((i, "k", gone))
    assert got == want and not step.parts and step.parts.most <= 7 and not step.runs.exists()


def test_a_run_is_all_that_is_held(monkeypatch):
    monkeypatch.setattr(stateful, "RUN", 50)
    held = []
    kept = stateful.InOrder._keep
    monkeypatch.setattr(stateful.InOrder, "_keep", lambda self, runs, come: held.append(len(come)) or kept(self, runs, come))
    rows = [(i % 97, i, "a") for i in range(1000)]
    _run(stateful._Folding(["item"], "evicted", folds.recently_used(3)), [[rows[i : i + 20] for i in range(0, 1000, 20)]], [500])
    assert sum(held) == 1000 and max(held) < 50 + 20


def test_lives_go_on_across_slices(monkeypatch):
    monkeypatch.setattr(stateful, "SLICE", 2)
    rows = [(t, i, "") for i, t in enumerate([0, 10, 20, 29, 60, 65, 100])]
    got = _run(stateful._Lives(30), [[rows]], [1000])
    assert [(x[1].second + 60 * x[1].minute, x[2].second + 60 * x[2].minute, x[3]) for x in got] == [(0, 29, 4), (60, 65, 2), (100, 100, 1)]
