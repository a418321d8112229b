"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from traitloom.session import bounded_batches, forget, materialise, shared_dir, table

__all__ = ["bounded_batches", "forget", "materialise", "merge_labels", "shared_dir", "table"]

def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest-index labels after joining the classes of ``u[i]`` and ``v[i]``; labels are roots on entry."""
    while True:
        a, b = labels[u], labels[v]
        open_ = a != b
        if not open_.any():
            return labels
        a, b = a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
        u, v = u[open_], v[open_]
