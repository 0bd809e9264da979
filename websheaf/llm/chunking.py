"""Content-defined chunking with a rolling hash, over bytes or over token ids."""

from __future__ import annotations

import numpy as np

#: The rolling hash reaches back over this many symbols.
WINDOW = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads small integers over 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOLS = _mixed(np.arange(1 << 16)).astype(np.uint32)


def rolling_hash(symbols: np.ndarray) -> np.ndarray:
    """h[i] = sum of T[s[i-j]] << j for j under WINDOW, built in log2(WINDOW) doubling steps."""
    h = _SYMBOLS[symbols] if symbols.dtype.itemsize <= 2 else _mixed(symbols).astype(np.uint32)
    step = 1
    while step < WINDOW:
        older = h[:-step] << np.uint32(step) if len(h) > step else h[:0]
        h = h.copy()
        h[step:] += older
        step *= 2
    return h


def chunk_ends(symbols: np.ndarray, bounds: list[int], least: int, mean: int, most: int) -> list[list[int]]:
    """Chunk ends of each document [bounds[i], bounds[i+1]) of `symbols`.

    A chunk ends after a symbol whose rolling hash has its top bits clear (one in `mean` symbols), but holds `least` to
    `most` symbols (a document's last one may be shorter). `least` is no less than WINDOW, so a cut never depends on
    symbols in front of its own chunk, and equal contents are cut alike wherever they stand.
    """
    if least < WINDOW:
        raise ValueError(f"chunks need at least {WINDOW} symbols")
    cuts = np.flatnonzero(rolling_hash(symbols) < np.uint32(2**32 // mean)) + 1 if len(symbols) else np.zeros(0, int)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        ends, at = [], a
        own = cuts[np.searchsorted(cuts, a + least) : np.searchsorted(cuts, b)].tolist()
        for cut in own:
            while cut - at > most:
                at += most
                ends.append(at)
            if cut - at >= least:
                at = cut
                ends.append(at)
        while b - at > most:
            at += most
            ends.append(at)
        if b > at:
            ends.append(b)
        out.append(ends)
    return out
