"""Results kept by question, and graphs that are swapped while they are read."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

from strataloom.graph import CodeGraph


class ResultCache:
    """Answers of operators over one graph, persisted by name and arguments. Calls that change with the graph need a new cache."""

    def __init__(self, g: CodeGraph):
        self.g, self.held, self.hits, self.misses = g, {}, 0, 0

    def __call__(self, operator: Callable[..., DataFrame], *args) -> DataFrame:
        key = (operator, args)
        if key in self.held:
            self.hits += 1
        else:
            self.misses += 1
            self.held[key] = operator(self.g, *args).persist()
        return self.held[key]

    @property
    def hit_rate(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()
        self.hits = self.misses = 0


class LiveGraph:
    """A graph that readers take as a whole. refresh() builds the next one, here or in the background, and swaps it in when it is done; one at a time."""

    def __init__(self, build: Callable[[], CodeGraph]):
        self.build, self.graph, self.error = build, build(), None
        self._one = threading.Lock()

    @property
    def rebuilding(self) -> bool:
        return self._one.locked()

    def refresh(self, wait: bool = True) -> bool:
        """False if a build is under way already. A failed build leaves the graph as it is and its error in `error`."""
        if not self._one.acquire(blocking=False):
            return False
        work = threading.Thread(target=self._run, daemon=True)
        work.start()
        if wait:
            work.join()
        return True

    def _run(self) -> None:
        try:
            self.graph, self.error = self.build(), None
        except Exception as e:  # told to whoever asks, the old graph stays
            self.error = e
        finally:
            self._one.release()
