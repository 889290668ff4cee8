"""Per-key state machines over time-ordered rows.

Rows are partitioned by key, sorted and streamed through the machine, so a key with most of the rows is
never collected; its state is all that is held.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def stepped(df: DataFrame, key: list[str], order: list[str], schema: str, machine: Callable[[], Callable[[tuple], tuple | None]]) -> DataFrame:
    """Runs a fresh ``machine()`` over the rows of each key in order; each row gives one row or None."""
    columns = df.columns
    places = [columns.index(k) for k in key]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                k = tuple(row[p] for p in places)
                if step is None or k != current:
                    current, step = k, machine()
                got = step(row)
                if got is not None:
                    out.append(got)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def limiter(most: int, seconds: float) -> Callable[[], Callable[[tuple], tuple]]:
    """Admits a row while fewer than ``most`` were admitted in the last ``seconds``; refusals don't count.

    Rows are (key, id, time); gives (key, id, admitted).
    """

    def machine():
        times: deque = deque()

        def step(row):
            key, i, at = row
            while times and (at - times[0]).total_seconds() >= seconds:
                times.popleft()
            admitted = len(times) < most
            if admitted:
                times.append(at)
            return key, i, admitted

        return step

    return machine


def rollover(days: int) -> Callable[[], Callable[[tuple], tuple]]:
    """Periods of ``days`` that begin with the first row after the last one's end.

    Rows are (key, id, time, amount); gives (key, id, period_start, used so far in it).
    """

    def machine():
        start, used = None, 0.0

        def step(row):
            nonlocal start, used
            key, i, at, amount = row
            if start is None or (at - start).days >= days:
                start, used = at, 0.0
            used += amount
            return key, i, start, round(used, 6)

        return step

    return machine


def bounded_store(budget: int, ttl: float) -> Callable[[], Callable[[tuple], tuple]]:
    """A ``BoundedStore`` per key; rows are (key, id, time, size); gives (key, id, number evicted, bytes held)."""

    def machine():
        store = BoundedStore(budget, ttl)

        def step(row):
            key, i, at, size = row
            gone = store.put(i, int(size or 0), at.timestamp())
            return key, i, len(gone), store.size

        return step

    return machine


class BoundedStore:
    """Items with a time to live, a byte budget and least-recently-used eviction."""

    def __init__(self, budget: int, ttl: float):
        self.budget, self.ttl, self.size = budget, ttl, 0
        self.items: OrderedDict = OrderedDict()

    def put(self, key, size: int, now: float) -> list:
        """Stores an item and gives the keys evicted for it; an item above the budget is refused."""
        gone = [k for k, (_, until) in self.items.items() if until <= now]
        if key in self.items:
            gone.append(key)
        for k in dict.fromkeys(gone):
            self.size -= self.items.pop(k)[0]
        out = [k for k in gone if k != key]
        if size > self.budget:
            return out
        while self.size + size > self.budget:
            k, (s, _) = self.items.popitem(last=False)
            self.size -= s
            out.append(k)
        self.items[key] = size, now + self.ttl
        self.size += size
        return out

    def get(self, key, now: float) -> bool:
        """Whether the item is there; a hit makes it the most recent."""
        held = self.items.get(key)
        if held is None or held[1] <= now:
            return False
        self.items.move_to_end(key)
        return True
