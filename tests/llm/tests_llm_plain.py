"""Brute-force results that several tests share."""

import numpy as np
from test_setsketch import plain_components  # noqa: F401


def plain_removed(docs):
    """What is left of each (id, bytes) without the 50-byte strings of smaller ids."""
    least = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            least[w] = min(d, least.get(w, d))
    left = {}
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        left[d] = np.frombuffer(t, np.uint8)[~gone].tobytes()
    return left
