"""Settings of a normalization run and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

VERBOSITIES = ("minimal", "standard", "full")


def parse_verbosity(name: str | None) -> str:
    """Anything that is not a known level means ``standard``."""
    return name if name in VERBOSITIES else "standard"


@dataclass(frozen=True)
class Options:
    threshold: float | None = None  # None: that of the embedder
    verbosity: str = "standard"
    strip_fields: tuple[str, ...] | None = None
    dedup_window_s: float = 5.0
    limit: int = 0

    def validate(self) -> "Options":
        problems = []
        if self.threshold is None:
            pass
        elif not math.isfinite(self.threshold):
            problems.append(f"threshold is no finite number: {self.threshold}")
        elif not 0 <= self.threshold <= 1:
            problems.append(f"threshold lies outside 0 to 1: {self.threshold}")
        if self.verbosity not in VERBOSITIES:
            problems.append(f"unknown verbosity {self.verbosity!r}, known are {', '.join(VERBOSITIES)}")
        for name in ("dedup_window_s", "limit"):
            if getattr(self, name) < 0:
                problems.append(f"{name} is below zero: {getattr(self, name)}")
        if problems:
            raise ValueError("; ".join(problems))
        return self


def check_range(start: datetime | None, end: datetime | None) -> None:
    """A one-shot query needs both bounds, in order."""
    if start is None or end is None:
        raise ValueError("one-shot runs take a lower and an upper time")
    if not start < end:
        raise ValueError(f"empty time range: {start.isoformat()} to {end.isoformat()}")
