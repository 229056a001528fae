"""Corpus documents that hold passages of evaluation items.

Two texts that share an unbroken run of L characters share every window inside it. Documents are cut into windows of
W characters, one every S characters, with W + S - 1 = L, so that any run of L characters holds one of them whole;
items give their windows at every position. A window is summarized by a 64-bit SimHash of its weighted shingles, and
the fingerprints are looked up by multi-index Hamming blocks: within a radius r two fingerprints agree in at least one
of r + 1 blocks. What the blocks return is verified exactly.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dupscape.llm.lookalikes import comparable, slices
from dupscape.llm.near_edits import mix
from dupscape.session import spread

SHINGLE = 4
CHUNK = 1 << 20


def shingle_hashes(cps: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of the ``size`` code points that begin at each position (the last ones wrap into nothing)."""
    n = max(len(cps) - size + 1, 0)
    with np.errstate(over="ignore"):
        h = cps[:n].astype(np.uint64)
        for i in range(1, size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + cps[i : n + i]
    return mix(h)


def simhash(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of the ``count`` consecutive shingle hashes at each start: bit by bit the majority, ties giving 0.

    A shingle's weight is its number of occurrences in the window. The votes of all 64 bits are counted at once in
    bit-sliced counters.
    """
    planes = [np.zeros(len(starts), np.uint64) for _ in range(count.bit_length())]
    for i in range(count):
        carry = hashes[starts + i]
        for p in range((i + 1).bit_length()):
            planes[p], carry = planes[p] ^ carry, planes[p] & carry
    above, equal = np.zeros(len(starts), np.uint64), np.full(len(starts), ~np.uint64(0))
    least = count // 2  # a bit is set where its votes exceed half
    for p in reversed(range(len(planes))):
        if least >> p & 1:
            equal &= planes[p]
        else:
            above |= equal & planes[p]
            equal &= ~planes[p]
    return above


class HammingBlocks:
    """Fingerprints found within ``radius`` by radius + 1 blocks of bits, none missed."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        self.parts = [(np.uint64(a), np.uint64((1 << b - a) - 1)) for a, b in zip(edges, edges[1:])]
        self.orders, self.keys, self.seen = [], [], []
        for shift, mask in self.parts:
            key = prints >> shift & mask
            order = np.argsort(key, kind="stable")
            self.orders.append(order)
            self.keys.append(key[order])
            seen = np.zeros(1 << 20, bool)
            seen[key & np.uint64(0xFFFFF)] = True
            self.seen.append(seen)

    def possible(self, queries: np.ndarray) -> np.ndarray:
        """Which queries may have a fingerprint within the radius, by one bit a block; none that has is lost."""
        out = np.zeros(len(queries), bool)
        for (shift, mask), seen in zip(self.parts, self.seen):
            out |= seen[queries >> shift & mask & np.uint64(0xFFFFF)]
        return out

    def lookup(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, fingerprint number) within the radius, each once."""
        found = []
        for (shift, mask), order, keys, seen in zip(self.parts, self.orders, self.keys, self.seen):
            key = queries >> shift & mask
            at = np.flatnonzero(seen[key & np.uint64(0xFFFFF)])
            lo, hi = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            n = hi - lo
            q = np.repeat(at, n)
            f = order[np.repeat(lo, n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)]
            near = np.bitwise_count(queries[q] ^ self.prints[f]) <= self.radius
            found.append(np.stack([q[near], f[near]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return both[0], both[1]


def run_hashes(cps: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` code points that begin at each position, put together from runs of doubled lengths."""
    n = len(cps) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, part, out = 1, cps.astype(np.uint64), None
    at = 0
    while True:
        if size & have:
            piece = part[at : at + n]
            out = mix(piece) if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + piece)
            at += have
        if at == size:
            return out
        part = mix(part[:-have] * np.uint64(0xD1342543DE82EF95) + part[have:])
        have *= 2


def shares_run(a: np.ndarray, b: np.ndarray, size: int, known: np.ndarray | None = None) -> bool:
    """Whether two texts hold an equal run of ``size`` code points, at any alignment; linear in their lengths.

    ``known`` are the hashes of b's runs. Equal hashes are followed by a comparison of the runs themselves.
    """
    ha, hb = run_hashes(a, size), run_hashes(b, size) if known is None else known
    _, i, j = np.intersect1d(ha, hb, return_indices=True)
    return any(np.array_equal(a[x : x + size], b[y : y + size]) for x, y in zip(i.tolist(), j.tolist()))


def weighted_jaccard(a: np.ndarray, b: np.ndarray, size: int = SHINGLE) -> float:
    """Sum of the lesser over sum of the greater shingle counts."""
    x, nx = np.unique(shingle_hashes(a, size), return_counts=True)
    y, ny = np.unique(shingle_hashes(b, size), return_counts=True)
    _, i, j = np.intersect1d(x, y, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    whole = int(nx.sum() + ny.sum()) - both
    return both / whole if whole else 0.0


@dataclass
class ItemIndex:
    """Items of one run length: compared texts, window fingerprints at every position, and their blocks."""

    run: int
    radius: int = 1
    ids: list = field(default_factory=list)
    texts: list[np.ndarray] = field(default_factory=list)

    @property
    def window(self) -> int:
        return (self.run + 1) // 2

    @property
    def stride(self) -> int:
        return self.run - self.window + 1

    def close(self) -> ItemIndex:
        prints, self.item, self.runs = [], [], [run_hashes(text, self.run) for text in self.texts]
        for number, text in enumerate(self.texts):
            starts = np.arange(max(len(text) - self.window + 1, 0))
            own = np.unique(simhash(shingle_hashes(text), starts, self.window - SHINGLE + 1))
            prints.append(own)
            self.item.append(np.full(len(own), number))
        self.item = np.concatenate(self.item)
        self.blocks = HammingBlocks(np.concatenate(prints), self.radius)
        return self

    def search(self, cps: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(document number, item number) of all documents in the batch that hold an item's passage.

        Equal windows of a document, and of an item, count once, so repetitive texts cost no product of their windows; each
        pair of a document and an item that shares a window is then verified once, over whole texts.
        """
        sizes = np.diff(offsets)
        n = np.maximum((sizes - self.window) // self.stride + 1, 0)
        n[sizes < self.window] = 0
        doc = np.repeat(np.arange(len(n)), n)
        starts = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * self.stride
        prints = simhash(hashes, starts, self.window - SHINGLE + 1)
        maybe = np.flatnonzero(self.blocks.possible(prints))
        seen = np.unique(np.stack([doc[maybe].astype(np.uint64), prints[maybe]]), axis=1)
        q, f = self.blocks.lookup(seen[1])
        found: set[tuple[int, int]] = set()
        for dn, number in np.unique(np.stack([seen[0][q].astype(np.int64), self.item[f]]), axis=1).T.tolist():
            if shares_run(cps[offsets[dn] : offsets[dn + 1]], self.texts[number], self.run, self.runs[number]):
                found.add((dn, number))
        return found


#: Blocks of a similarity fingerprint, and differing bits that are looked up in one.
SIM_BLOCKS, SIM_BLOCK_BITS = 4, 3


class SimilarIndex:
    """Items by length: a SimHash of each whole item, found within a radius from windows as long as the item.

    Four blocks of 16 bits: two fingerprints within ``4 * 3 + 3`` bits differ in at most three bits of one block, and each item is
    listed under all keys within three bits of its own, so a lookup is one search a block. Item lengths are grouped
    in steps of a tenth; windows overlap by seven eighths.
    """

    STEP, OVERLAP = 1.1, 8

    def __init__(self, ids: list, texts: list[np.ndarray], similarity: float) -> None:
        self.ids, self.texts, self.similarity = ids, texts, similarity
        self.radius = SIM_BLOCKS * SIM_BLOCK_BITS + SIM_BLOCKS - 1
        flips = [0] + [sum(1 << i for i in c) for k in range(1, SIM_BLOCK_BITS + 1) for c in itertools.combinations(range(16), k)]
        self.flips = np.array(flips, np.uint64)
        by: dict[int, list[int]] = {}
        for number, text in enumerate(texts):
            by.setdefault(round(math.log(max(len(text), SHINGLE), self.STEP)), []).append(number)
        self.groups = []
        for numbers in by.values():
            size = int(np.median([len(texts[n]) for n in numbers]))
            prints = np.array([simhash(shingle_hashes(texts[n]), np.zeros(1, np.int64), len(texts[n]) - SHINGLE + 1)[0] for n in numbers], np.uint64)
            tables = []
            for block in range(SIM_BLOCKS):
                keys = (prints >> np.uint64(16 * block) & np.uint64(0xFFFF))[:, None] ^ self.flips[None, :]
                order = np.argsort(keys.ravel(), kind="stable")
                edges = np.searchsorted(keys.ravel()[order], np.arange(65537, dtype=np.uint64))
                tables.append((edges, order // len(flips)))
            self.groups.append((size, np.array(numbers), prints, tables))

    def search(self, cps: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(document number, item number) where a stretch as long as the item reaches the similarity."""
        found: set[tuple[int, int]] = set()
        lengths = np.diff(offsets)
        for size, numbers, prints, tables in self.groups:
            stride = max(1, size // self.OVERLAP)
            # the last window ends with its document; a shorter document is one window
            n = np.where(lengths >= SHINGLE, np.maximum(-(-(lengths - size) // stride), 0) + 1, 0)
            doc = np.repeat(np.arange(len(n)), n)
            starts = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * stride
            starts = offsets[:-1][doc] + np.maximum(np.minimum(starts, lengths[doc] - size), 0)
            ends = np.minimum(starts + size, offsets[1:][doc])
            whole = ends - starts == size
            own = np.zeros(len(doc), np.uint64)
            if whole.any():
                own[whole] = simhash(hashes, starts[whole], size - SHINGLE + 1)
            for k in np.flatnonzero(~whole).tolist():
                own[k] = simhash(hashes, starts[k : k + 1], int(ends[k] - starts[k]) - SHINGLE + 1)[0]
            pairs = []
            for block, (edges, rows) in enumerate(tables):
                key = (own >> np.uint64(16 * block) & np.uint64(0xFFFF)).astype(np.int64)
                lo, count = edges[key], edges[key + 1] - edges[key]
                q = np.repeat(np.arange(len(own)), count)
                f = rows[np.repeat(lo, count) + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)]
                near = np.bitwise_count(own[q] ^ prints[f]) <= self.radius
                pairs.append(np.stack([q[near], f[near]]))
            q, f = np.unique(np.concatenate(pairs, axis=1), axis=1)
            for w, number in zip(q.tolist(), numbers[f].tolist()):
                if (int(doc[w]), number) in found:
                    continue
                text = self.texts[number]
                lo, hi = int(offsets[doc[w]]), int(offsets[doc[w] + 1])
                # the item's own length from the window on, moved by parts of a stride to either side
                for shift in range(-stride, stride + 1, max(1, stride // 4)):
                    at = min(max(int(starts[w]) + shift, lo), max(hi - len(text), lo))
                    if weighted_jaccard(cps[at : min(at + len(text), hi)], text) >= self.similarity:
                        found.add((int(doc[w]), number))
                        break
        return found


def item_indexes(rows, short: frozenset[str], run: int, short_run: int, radius: int, similarity: float | None = None) -> list:
    """Indexes by run length; items whose compared text is shorter than the run they need can share none.

    With ``similarity`` one index of whole items; items shorter than a shingle are similar to nothing.
    """
    by: dict[int, ItemIndex] = {}
    whole: tuple[list, list] = ([], [])
    for item, lang, text in rows:
        need = short_run if (lang or "").lower().split("-")[0].split("_")[0] in short else run
        cps, _ = comparable([text or ""])
        if similarity is not None:
            if len(cps) >= SHINGLE:
                whole[0].append(item)
                whole[1].append(cps)
        elif len(cps) >= need:
            index = by.setdefault(need, ItemIndex(need, radius))
            index.ids.append(item)
            index.texts.append(cps)
    if similarity is not None:
        return [SimilarIndex(*whole, similarity)] if whole[0] else []
    return [x.close() for x in by.values()]


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    item_lang: str = "lang",
    run: int = 60,
    short_run: int = 25,
    short_langs: tuple[str, ...] = ("zh",),
    radius: int = 1,
    similarity: float | None = None,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """``(key, item_key)``: every document and item that share an unbroken run of compared characters.

    Both texts are taken in one look-alike form, lower case, letters and digits only; the run is ``run`` characters, or
    ``short_run`` for items in ``short_langs``. With ``similarity`` it is instead every document with a stretch as long as the
    item whose weighted shingles reach that Jaccard similarity; stretches are windows of the item's size, found by SimHash
    within 15 bits, which the README gives the measured recall of. Items are a stated query set: they are taken to
    the executors in blocks of at most ``block_chars`` characters (checked by a sum over ``items``), and each block is
    searched in one pass over the documents, without a shuffle. Null and empty texts on either side match nothing;
    repeated documents or items give one row per distinct pair of keys.
    """
    spark = documents.sparkSession
    items = items.select(F.col(item_key).alias("item"), F.col(item_lang).alias("lang"), F.col(item_text).alias("text")).where("text is not null and text <> ''")
    total = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    kinds = f"{key} {documents.schema[key].dataType.simpleString()}, {item_key} {items.schema['item'].dataType.simpleString()}"
    types = [documents.schema[key].dataType, items.schema["item"].dataType]
    item_type = to_arrow_type(items.schema["item"].dataType)
    scan = spread(documents.select(key, text).where(F.col(text).isNotNull()))
    out = None
    for number in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        shared = spark.sparkContext.broadcast(item_indexes([(r.item, r.lang, r.text) for r in part.collect()], frozenset(short_langs), run, short_run, radius, similarity))

        def search(batches, shared=shared):
            indexes = shared.value
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                for a, b in slices(map(len, texts), CHUNK):
                    cps, offsets = comparable(texts[a:b])
                    hashes = shingle_hashes(cps)
                    rows = [(a + d, x.ids[i]) for x in indexes for d, i in x.search(cps, offsets, hashes)]
                    if rows:
                        taken = keys.take(pa.array([d for d, _ in rows]))
                        yield pa.RecordBatch.from_arrays([taken, pa.array([i for _, i in rows], item_type)], names=[key, item_key])

        found = scan.mapInArrow(search, kinds)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col(key).cast(types[0]), F.col(item_key).cast(types[1])).distinct()
