"""Perceptual hashes as signed 64-bit patterns: distances, bands, and the hash itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest distance threshold.
LEAST, MOST = 1, 12


def clamp(threshold: int) -> int:
    return max(LEAST, min(MOST, threshold))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cuts(threshold: int, agreeing: int = 1) -> list[tuple[int, int]]:
    """Lowest bit and mask of threshold + agreeing bands over all 64 bits."""
    count = clamp(threshold) + agreeing
    ends = [i * 64 // count for i in range(count + 1)]
    return [(low, (1 << high - low) - 1) for low, high in zip(ends, ends[1:])]


def bands(value: Column, threshold: int, agreeing: int = 1) -> Column:
    """threshold + agreeing structs (band, bits) over all 64 bits: hashes within the threshold agree in at least so many."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(value, low).bitwiseAND(F.lit(mask)).alias("bits")) for i, (low, mask) in enumerate(cuts(threshold, agreeing))])


#: From this length on the rows of one key are compared as a table, below it one place apart, two, and so on; cells of such a table.
LONG, CELLS = 256, 1 << 17


def near_in_band(hashes: np.ndarray, own: np.ndarray, group: np.ndarray, band: int, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(x, y)`` within the threshold whose first agreeing band, of threshold + 2, is this one.

    ``hashes`` (uint64) are different within a ``group`` (below 2^20); each pair's lesser hash must be ``own``. Pairs within the threshold
    agree in a second band, so only rows that share one are compared, and a pair counts at the first such band.
    """
    t, places = clamp(threshold), cuts(threshold, 2)
    bits = lambda values, k: values >> np.uint64(places[k][0]) & np.uint64(places[k][1])
    order = np.argsort(hashes)
    hashes, own = hashes[order], own[order]
    first = (group[order].astype(np.uint64) << np.uint64(22) | bits(hashes, band)) << np.uint64(22)
    for second in range(band + 1, len(places)):
        key = first | bits(hashes, second)
        order = np.argsort(key, kind="stable")
        key, h, mine = key[order], hashes[order], own[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        earlier = [k for k in range(second) if k != band]

        def kept(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            apart = np.ones(len(x), bool)
            for k in earlier:  # noqa: B023
                apart &= bits(x ^ y, k) != 0
            return x[apart], y[apart]

        for start, end in zip(*(v[ends - starts >= LONG].tolist() for v in (starts, ends))):
            step = max(1, CELLS // (end - start))
            for low in range(start, end, step):
                p, q = np.nonzero(np.bitwise_count(h[low : min(low + step, end), None] ^ h[None, low:end]) <= t)
                chosen = (p < q) & mine[low + p]
                if chosen.any():
                    yield kept(h[low + p[chosen]], h[low + q[chosen]])
        sizes = ends - starts
        left = np.repeat(ends, sizes) - np.arange(len(key)) - 1  # rows of the key that follow
        left[~mine | (np.repeat(sizes, sizes) >= LONG)] = 0
        at = np.argsort(-left, kind="stable")
        after = np.cumsum(np.bincount(left)[::-1])[::-1]  # rows with at least so many that follow
        for apart in range(1, len(after)):
            rows = at[: after[apart]]
            x, y = h[rows], h[rows + apart]
            hit = np.bitwise_count(x ^ y) <= t
            if hit.any():
                yield kept(x[hit], y[hit])


def difference_hash(gray: np.ndarray) -> int:
    """64 bits of an 8 x 9 grid, row by row, first bit highest: whether a cell is brighter than the one to its right."""
    flags = np.asarray(gray).reshape(8, 9)
    return int.from_bytes(np.packbits((flags[:, :-1] > flags[:, 1:]).ravel()).tobytes(), "big", signed=True)


def grid_hash(grid: Column) -> Column:
    """The same over an array column of 72 brightness values, in the JVM."""
    out = F.lit(0).cast("bigint")
    for row in range(8):
        for col in range(8):
            at = row * 9 + col
            bit = F.when(F.get(grid, F.lit(at)) > F.get(grid, F.lit(at + 1)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
            out = out.bitwiseOR(F.call_function("shiftleft", bit, F.lit(63 - row * 8 - col)))
    return out
