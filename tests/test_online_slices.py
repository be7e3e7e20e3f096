"""The buffer of a series: slices of time, one at a time in memory."""

import math
import random

import numpy as np
import pandas as pd

from tidemark.streaming import online

HOUR = 3_600_000_000


class State(dict):
    """Value and map states, and timers, in a dictionary."""

    def getMapState(self, *_):
        return State()

    getValueState = getMapState
    exists = lambda self: None in self
    get = lambda self: dict.get(self, None)
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__

    def update(self, value):
        self[None] = value

    def registerTimer(self, at):
        self["timer"] = at


class Clock:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = lambda: at // 1000


def test_a_slice_at_a_time():
    rng = random.Random(3)
    rows = [(i * HOUR // 100, rng.gauss(0, 1)) for i in range(1000)]
    come = rng.sample(rows, len(rows))
    p, state = online.RunLengths(50.0, 0.0, 1.0, "student_t", 32), State()
    p.init(state)
    frames = lambda part: iter([pd.DataFrame(part[i : i + 150], columns=["at", "x"]) for i in range(0, len(part), 150)])
    assert not list(p.handleInputRows(("s",), frames(come), None))
    first = list(p.handleExpiredTimer(("s",), Clock(rows[450][0]), None))
    assert sum(p.waiting()[0].values()) > 0 and state["timer"] == rows[450][0] // 1000 + 1
    late = list(p.handleInputRows(("s",), frames([rows[3]]), None))
    assert len(late) == 1 and late[0]["late"].tolist() == [True]
    rest = list(p.handleExpiredTimer(("s",), Clock(rows[-1][0] + HOUR), None))
    assert max(map(len, first + rest)) == 100  # the rows of an hour
    told = pd.concat(first + rest)
    assert told["at"].tolist() == [at for at, _ in rows] and told["t"].tolist() == list(range(1000)) and p.waiting() == ({}, rows[-1][0]) and not p.parts
    runs = tuple(np.array([v]) for v in (0.0, 0.0, 1.0, 1.0))
    for (_, x), got in zip(rows[1:], told["p"].tolist()[1:], strict=True):
        runs = online.advance(runs, x, (0.0, 1.0), 1 / 50, longest=32)
        assert got == math.exp(runs[0][0])


def test_few_calls_of_the_state():
    """A series that comes and is taken once: the time of a call is what a stream of many small series costs."""
    calls = []

    class Counted(State):
        def __getattribute__(self, name):
            if name in ("exists", "get", "getValue", "updateValue", "removeKey", "update", "registerTimer"):
                calls.append(name)
            return super().__getattribute__(name)

        def getMapState(self, *_):
            return Counted()

        getValueState = getMapState

    p = online.Relapses(3.0, 1, 5)
    p.init(Counted())
    visits = pd.DataFrame([(i * online.DAY, float(x)) for i, x in enumerate([5, 9, 1, 8])], columns=["at", "x"])
    assert not list(p.handleInputRows(("s",), iter([visits]), None)) and len(calls) == 4
    out = pd.concat(p.handleExpiredTimer(("s",), Clock(3 * online.DAY), None))
    assert out["increase"].tolist() == [4.0] and len(calls) <= 11
