"""Trying again with growing pauses, and falling back: for jobs that read what may not be there yet."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import TypeVar

R = TypeVar("R")
#: Tries, seconds that each failure adds to the pause before the next try, and the longest pause.
TRIES, STEP, LONGEST = 3, 5.0, 15.0


def attempted(action: Callable[[], R], attempts: int = TRIES, step: float = STEP, longest: float = LONGEST, retry: Callable[[Exception], bool] = lambda e: True, between: Callable[[int], None] | None = None) -> R:
    """The result of ``action``, tried up to ``attempts`` times.

    After a failure that ``retry`` approves, ``between`` (with the number of the try that failed) may
    clean up; the next try waits ``step`` seconds more than the one before, ``longest`` at most. The
    last failure is raised as it is; ``first_success`` takes it to a fallback.
    """
    for n in range(1, attempts + 1):
        try:
            return action()
        except Exception as e:
            if n == attempts or not retry(e):
                raise
            if between is not None:
                between(n)
            time.sleep(min(step * n, longest))
    raise ValueError("attempts must be 1 or more")


def first_success(actions: Sequence[Callable[[], R]]) -> R:
    """The result of the first action that does not fail; the last failure if all do."""
    for action in actions[:-1]:
        try:
            return action()
        except Exception:
            continue
    return actions[-1]()
