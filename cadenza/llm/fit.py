"""A small limited-memory BFGS minimiser (two-loop recursion, backtracking line search)."""

from __future__ import annotations

import numpy as np


def minimise(f, x: np.ndarray, rounds: int = 150, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """``f(x)`` gives the value and the gradient."""
    value, g = f(x)
    s, y = [], []
    for _ in range(rounds):
        q, a = g.copy(), []
        for si, yi in zip(reversed(s), reversed(y), strict=True):
            a.append(si @ q / (yi @ si))
            q -= a[-1] * yi
        if s:
            q *= (s[-1] @ y[-1]) / (y[-1] @ y[-1])
        for si, yi, ai in zip(s, y, reversed(a), strict=True):
            q += (ai - yi @ q / (yi @ si)) * si
        slope = g @ q
        if slope <= 0:
            q, slope, s, y = g.copy(), g @ g, [], []
        step = 1.0 if s else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
        while True:
            new, gn = f(x - step * q)
            if new <= value - 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        d, e = -step * q, gn - g
        done = value - new < tolerance * max(1.0, abs(value)) * 1e-2
        x, value, g = x + d, new, gn
        if d @ e > 1e-12:
            s, y = [*s, d][-memory:], [*y, e][-memory:]
        if done:
            break
    return x
