"""Which of many keyword sets a text holds whole: one pass of an automaton over the text, whatever the number of sets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Finder:
    """A set is looked at only where its rarest keyword occurs. A set without keywords is in every text, one with a null in none."""

    def __init__(self, sets: list[list[str | None]]):
        known = [(i, {k for k in s if k}) for i, s in enumerate(sets) if None not in s]
        uses = Counter(k for _, s in known for k in s)
        self.always = [i for i, s in known if not s]
        self.anchored: dict[str, list[tuple[int, set[str]]]] = {}
        self.automaton = ahocorasick.Automaton()
        for i, s in known:
            if s:
                anchor = min(s, key=lambda k: (uses[k], -len(k), k))
                self.anchored.setdefault(anchor, []).append((i, s - {anchor}))
        for k in uses:
            self.automaton.add_word(k, k)
        if uses:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[int]:
        if text is None:
            return []
        met = {k for _, k in self.automaton.iter(text)} if len(self.automaton) else set()
        return sorted([*self.always, *(i for k in met for i, rest in self.anchored.get(k, ()) if rest <= met)])


def sets_within(spark: SparkSession, sets: list[list[str | None]]) -> Callable[[Column], Column]:
    """A function from a text column to the sorted numbers of the sets (a bounded list, broadcast) that the text holds."""
    shared = spark.sparkContext.broadcast(sets)

    @F.pandas_udf("array<int>")
    def find(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(shared.value)
        for s in series:
            yield s.map(finder.find)

    return find.asNondeterministic()  # so that a filter doesn't search twice
