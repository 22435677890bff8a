"""What a stream asks of its state."""

from __future__ import annotations

import pandas as pd

from colligo.streaming import jobs


def test_cooldown_asks_the_state_once_for_a_key():
    class Last:
        def __init__(self):
            self.asked, self.value = 0, None

        def get(self):
            self.asked += 1
            return self.value

        def exists(self):
            self.asked += 1
            return self.value is not None

        def update(self, value):
            self.value = value

    made = jobs._Cooldown(1, None)
    made.last = last = Last()
    rows = [pd.DataFrame({"event_id": [3, 1], "level": "a", "title": 5, "at": [2_500_000, 0]}), pd.DataFrame({"event_id": [2], "level": "a", "title": 5, "at": [500_000]})]
    got = pd.concat(made.handleInputRows(("a", 5), iter(rows), None))
    assert got.to_dict("list") == {"event_id": [1, 3], "level": ["a", "a"], "title": [5, 5], "at": [0, 2_500_000]}
    assert last.asked == 1 and last.value == (2_500_000,)
    more = list(made.handleInputRows(("a", 5), iter([pd.DataFrame({"event_id": [4], "level": "a", "title": 5, "at": [3_000_000]})]), None))
    assert sum(len(x) for x in more) == 0 and last.asked == 2 and last.value == (2_500_000,)
