"""Digests within one batch do without state; what a batch leaves over is kept for the next."""

import json

import pandas as pd

from rambleweave.operators.touches import TouchConfig
from rambleweave.streaming.digests import _Digests


class Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


class Map(dict):
    calls = 0

    def containsKey(self, k):
        self.calls += 1
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def iterator(self):
        self.calls += 1
        return iter(list(self.items()))


class Handle:
    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()


def test_state_between_batches_only():
    p = _Digests(TouchConfig(500, 3, 5), 1000)
    p.init(Handle())
    first = pd.DataFrame([(f"t{i % 700}", "s", 1) for i in range(10_300)], columns=["target", "src", "n"])
    rows = pd.concat(list(p.handleInputRows(("",), iter([first]), None)))
    assert rows["total"].tolist() == [500] * 20
    assert p.targets.calls + p.sources.calls < 310  # the 300 touches left over, not 10,300
    assert sum(v[0] for v in p.targets.values()) == 300
    second = pd.DataFrame([("t1", "u", 1150)], columns=["target", "src", "n"])
    rows = pd.concat(list(p.handleInputRows(("",), iter([second]), None)))
    assert rows["total"].tolist() == [500, 500] and rows["digest_no"].tolist() == [21, 22]
    assert {x["id"]: x["count"] for x in json.loads(rows["sources"].iloc[0])} == {"s": 300, "u": 200}
    assert {x["id"]: x["count"] for x in json.loads(rows["targets"].iloc[1])} == {"t1": 500}
    assert dict(p.targets) == {("t1",): (450,)} and dict(p.sources) == {("u",): (450,)}
