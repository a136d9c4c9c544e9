"""Runs of many lengths in arrays without a loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``sizes`` with sums of about ``most``, and at least one entry each."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


def flat(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs that begin at ``starts``, and the number of the run of each."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes), np.repeat(np.arange(len(sizes)), sizes)
