"""Time budgets of stages: a deadline has children that never outlast it. Driver side only."""

from __future__ import annotations

import time
from collections.abc import Callable

# Seconds that a case and its stages may take.
STAGE_SECONDS = {"case": 360.0, "understanding": 25.0, "retrieval": 70.0, "evidence": 100.0, "listwise": 90.0, "synthesis": 25.0}


class Deadline:
    """Counts down from `seconds`, or from what its parent has left if that is less."""

    def __init__(self, seconds: float, parent: Deadline | None = None, clock: Callable[[], float] = time.perf_counter) -> None:
        self.clock = clock
        self.end = clock() + (seconds if parent is None else min(seconds, parent.remaining()))

    def remaining(self) -> float:
        return max(0.0, self.end - self.clock())

    def expired(self) -> bool:
        return self.clock() >= self.end

    def child(self, seconds: float, reserve: float = 0.0) -> Deadline:
        """A deadline of at most `seconds` that leaves its parent `reserve`."""
        return Deadline(min(seconds, max(0.0, self.remaining() - reserve)), self, self.clock)

    def timeout(self, most: float) -> float:
        """Seconds to give a single call: at most `most` and what is left, but one at least."""
        return max(1.0, min(most, self.remaining()))
