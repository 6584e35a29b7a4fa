"""The stateful processor against a fold event by event, and how often it asks its store."""

import numpy as np
import pandas as pd

from spindrift.streaming.feedback import FeedbackProcessor


class Store:
    def __init__(self, calls):
        self.calls, self.rows, self.one = calls, {}, None

    def _told(self, out=None):
        self.calls.append(1)
        return out

    def getValue(self, key):
        return self._told(self.rows.get(key))

    def containsKey(self, key):
        return self._told(key in self.rows)

    def updateValue(self, key, value):
        self._told(self.rows.update({key: value}))

    def removeKey(self, key):
        self._told(self.rows.pop(key))

    def exists(self):
        return self._told(self.one is not None)

    def get(self):
        return self._told(self.one)

    def update(self, value):
        self.one = self._told(value)


def test_a_batch_asks_the_store_by_items_not_by_events():
    calls = []
    p, items, last = FeedbackProcessor(), Store(calls), Store(calls)
    p.items, p.last = items, last
    g = np.random.default_rng(4)
    n = 600
    d = pd.DataFrame({"axis": "a", "seq": np.arange(n), "kind": g.choice(["score", "undefined", "delete"], n), "item": g.choice(["x", "y", "z", None], n), "target": g.uniform(-20, 120, n)})
    state, want = {}, []
    for r in d.to_dict("records"):
        if r["kind"] == "delete":
            state.pop(r["item"], None)
        else:
            state[r["item"]] = r["kind"]
        of = list(state.values())
        value = min(100.0, max(0.0, r["target"])) if r["kind"] == "score" else None
        want.append(("a", r["seq"], r["item"], "deleted" if r["kind"] == "delete" else r["kind"], value, of.count("score"), of.count("undefined")))
    out = []
    # two batches, rows out of order and in pieces; the second brings late rows and repeats its own
    for batch in (d[:400], pd.concat([d[100:200], d[400:], d[450:470]])):
        mixed = batch.sample(frac=1.0, random_state=1)
        calls.clear()
        out += list(p.handleInputRows(("a",), iter([mixed[:50], mixed[50:]]), None))
        assert len(calls) <= 3 + 2 * 4
    got = [tuple(None if pd.isna(v) else v for v in r) for r in pd.concat(out)[["axis", "seq", "item", "kind", "target", "moves", "undefined"]].itertuples(index=False)]
    assert got == want
    assert {k[0]: v[0] for k, v in items.rows.items()} == state
    late = list(p.handleInputRows(("a",), iter([d[:5]]), None))
    assert sum(map(len, late)) == 0 and last.one[0] == n - 1
