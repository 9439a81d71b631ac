"""Gray-order hierarchical index over 64-bit fingerprints, in numpy.

Fingerprints are sorted by Gray rank, runs of neighbours become nodes that hold
the bits all their members share (mask and pattern), and runs of nodes become
upper nodes. A search goes down from pairs of roots and drops a pair of whole
groups once the shared bits alone differ in more than ``max_bits`` places.
"""

from __future__ import annotations

import numpy as np

FAN = 8
SLICE = 1 << 17


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    r = fp.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(s))
    return r


def _levels(fp: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Bottom-up levels of (pattern, mask, first child of each node and end).

    ``first``: start of each bucket among the entries. The top level has one
    node per bucket.
    """
    pat, mask = fp, np.full(len(fp), ~np.uint64(0))
    starts = first
    levels = [(pat, mask, None)]
    while True:
        sizes = np.diff(np.append(starts, len(pat)))
        if len(levels) > 1 and sizes.max() == 1:
            return levels
        parents = -(-sizes // FAN)
        new_starts = np.cumsum(parents) - parents
        bucket = np.repeat(np.arange(len(starts)), parents)
        child = starts[bucket] + (np.arange(parents.sum()) - new_starts[bucket]) * FAN
        ends = np.append(child[1:], len(pat))
        lead = np.repeat(pat[child], ends - child)
        differ = np.bitwise_or.reduceat(pat ^ lead, child)
        new_mask = np.bitwise_and.reduceat(mask, child) & ~differ
        pat, mask, starts = pat[child] & new_mask, new_mask, new_starts
        levels.append((pat, mask, np.append(child, ends[-1:])))


def _pairs(ca: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All child pairs of the node pairs (a, b); equal nodes give each pair once."""
    na, nb = ca[a + 1] - ca[a], ca[b + 1] - ca[b]
    n = na * nb
    at = np.repeat(np.arange(len(a)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x, y = ca[a][at] + k // nb[at], ca[b][at] + k % nb[at]
    keep = (a[at] != b[at]) | (x <= y)
    return x[keep], y[keep]


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Merge the sets of x[i] and y[i]; labels become set minima."""
    while len(x):
        lx, ly = label[x], label[y]
        open_ = lx != ly
        if not open_.any():
            return
        x, y = x[open_], y[open_]
        np.minimum.at(label, np.maximum(lx, ly)[open_], np.minimum(lx, ly)[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def link_buckets(fp: np.ndarray, bucket: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints of one bucket at ``max_bits`` or fewer
    differing bits: pairs (fp, other) whose closure is that of all such pairs.

    Pairs of nodes are expanded depth first in slices, so memory stays bounded
    however many links a dense bucket holds.
    """
    if not len(fp):
        return fp, fp
    fp = fp.astype(np.uint64)
    order = np.lexsort((gray_rank(fp), bucket))
    fp, bucket = fp[order], bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    levels = _levels(fp, first)
    label = np.arange(len(fp))
    roots = np.arange(len(first))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > SLICE // FAN ** 2:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        x, y = _pairs(levels[level][2], a, b)
        pat, mask, _ = levels[level - 1]
        near = np.bitwise_count((pat[x] ^ pat[y]) & mask[x] & mask[y]) <= max_bits
        x, y = x[near], y[near]
        if level > 1:
            if len(x):
                stack.append((level - 1, x, y))
        else:
            real = x < y
            _unite(label, x[real], y[real])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return fp[linked], fp[label[linked]]
