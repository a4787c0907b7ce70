"""A user's timeline asks the state a bounded number of times a micro-batch and holds one timer, whatever it contains."""

import random

import pandas as pd
import pytest

from feedforge.streaming import recency


class State:
    """Map and value state of one user, with a count of calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def called(self, result=None):
        self.calls += 1
        return result

    get = lambda self: self.called(self.values.get(()))
    exists = lambda self: self.called(() in self.values)
    update = lambda self, value: self.called(self.values.update({(): value}))
    iterator = lambda self: iter(self.called(list(self.values.items())))
    containsKey = lambda self, key: self.called(key in self.values)
    getValue = lambda self, key: self.called(self.values[key])
    updateValue = lambda self, key, value: self.called(self.values.update({key: value}))
    removeKey = lambda self, key: self.called(self.values.pop(key))


class Handle:
    def __init__(self):
        self.states, self.timers, self.watermark = [], set(), 0

    def getMapState(self, *_):
        self.states.append(State())
        return self.states[-1]

    def getValueState(self, *_):
        return self.getMapState()

    def registerTimer(self, at):
        assert at > self.watermark
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def calls(self):
        return sum(s.calls for s in self.states)


def started(cap):
    processor, handle = recency.timeline_processor(cap)(), Handle()
    processor.init(handle)
    return processor, handle


def come(processor, handle, rows, chunk=1000):
    names = ["item_id", "ts_s", "item_type", "row_id"]
    chunks = [pd.DataFrame(rows[i : i + chunk], columns=names) for i in range(0, len(rows), chunk)]
    return list(processor.handleInputRows((7,), iter(chunks), handle))


def expire(processor, handle, watermark):
    """Fires timers as Spark does; returns the changes and how many fired."""
    handle.watermark, out = watermark, []
    due = sorted(t for t in handle.timers if t <= watermark)
    for at in due:
        out += processor.handleExpiredTimer((7,), handle, None)
        handle.timers.discard(at)
    return out, len(due)


def test_one_timer_and_few_calls_for_many_items():
    processor, handle = started(500)
    come(processor, handle, [(i, 1000 + i, 0, i) for i in range(400)])
    assert handle.calls() < 40 and len(handle.timers) == 1
    before = handle.calls()
    changes, fired = expire(processor, handle, 1_300_000)
    assert fired == 1 and handle.calls() - before < 40
    assert pd.concat(changes).item_id.tolist() == list(range(300)) and handle.timers == {1_300_001}


@pytest.mark.parametrize("cap", [1, 5, 70, 500])
def test_pages_equal_a_plain_timeline(cap):
    rng = random.Random(cap)
    processor, handle = started(cap)
    line, live, at = [], {}, 0
    for batch in range(30):
        rows = [(rng.randrange(300), 10 * batch + rng.randrange(40), rng.randrange(3), at + i) for i in range(rng.choice([0, 1, 90]))]
        at += len(rows)
        changes = come(processor, handle, rows, 40) if rows else []
        for i in range(0, len(rows), 40):
            for row in sorted(rows[i : i + 40], key=lambda r: (r[1], r[3])):
                if all(row[0] != x[0] for x in line):
                    line = [*line, row][-cap:]
        watermark = 1000 * (10 * batch - 30)
        changes += expire(processor, handle, max(watermark, 0))[0]
        line = [row for row in line if row[1] * 1000 >= watermark]
        for c in changes:
            for user, place, gone, *row in c.itertuples(index=False):
                live.pop(place) if gone else live.update({place: tuple(row)})
        assert [live[p] for p in sorted(live)] == line and len(handle.timers) == (len(line) > 0)
