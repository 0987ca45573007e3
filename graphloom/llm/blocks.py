"""Local components inside one block of a distributed comparison."""

from __future__ import annotations

import numpy as np


def local_roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row (left) and column (right) of a link matrix reaches in it."""
    low_r, low_c = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while linked.size:
        new_r = np.minimum(low_r, np.where(linked, low_c[None, :], top).min(axis=1))
        new_c = np.minimum(low_c, np.where(linked, new_r[:, None], top).min(axis=0))
        if (new_r == low_r).all() and (new_c == low_c).all():
            break
        low_r, low_c = new_r, new_c
    return low_r, low_c
