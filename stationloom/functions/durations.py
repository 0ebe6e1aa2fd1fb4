"""Window lengths given as durations."""

from __future__ import annotations

import warnings
from datetime import timedelta

SECONDS = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400, "weeks": 604800}


def seconds_of(window: str | timedelta) -> float:
    """Seconds of a timedelta, or of text such as ``6 hours``; units may be shortened."""
    if isinstance(window, timedelta):
        return window.total_seconds()
    parts = str(window).split()
    if len(parts) != 2:
        raise ValueError(f"a window is a number and a unit, not {window!r}")
    try:
        count = float(parts[0])
    except ValueError:
        raise ValueError(f"no number in {window!r}") from None
    units = [u for u in SECONDS if u.startswith(parts[1])]
    if len(units) != 1 or count <= 0:
        raise ValueError(f"no positive duration: {window!r}")
    return count * SECONDS[units[0]]


def window_points(window: str | timedelta, step: float) -> int:
    """Points of a window, both ends included: at least 3."""
    if not step:
        raise ValueError("the panel has no time step")
    steps = seconds_of(window) / step
    points = round(steps) + 1
    if points < 3:
        raise ValueError(f"a window of {window} has fewer than 3 points at a step of {step} s")
    if steps != round(steps):
        warnings.warn(f"{window} is no whole number of steps of {step} s; {points} points are used", stacklevel=2)
    return points
