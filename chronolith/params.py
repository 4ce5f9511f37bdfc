"""Parameters of the activity views; durations are microseconds unless the name says otherwise."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000


@dataclass(frozen=True)
class Params:
    dwell_cap: int = 90 * SECOND
    session_gap: int = 300 * SECOND
    merge_flicker: int = 20 * SECOND
    min_minutes: float = 0.5
    timezone: str = "UTC"


DEFAULT = Params()
#: For the sparse per-user event streams of the test tables.
SCALED = Params(dwell_cap=14_400 * SECOND, session_gap=43_200 * SECOND, merge_flicker=3_600 * SECOND)
