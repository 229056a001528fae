"""Token ids of a whole corpus by a byte-level BPE vocabulary.

All pre-tokens of a batch that are not known yet are merged together. Their bytes form one linked list, cut at the
pre-tokens' ends. A queue holds one bucket per merge rank with the list positions where that merge applies, and a
two-level bitmap over the ranks; find-first-set gives the next rank, whose whole bucket is merged at once after
stale entries (positions whose neighbours have changed since) are skipped. The cost is in proportion to the bytes: a
pre-token of a million bytes costs what a million bytes of short ones do.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscape.llm.lookalikes import slices
from dupscape.session import spread

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: marks that end a word, each a pre-token of its own behind letters.
ENDS = frozenset(",.;:!?")
#: Characters of text that are split and merged together; known units that a worker keeps, and their greatest length.
CHUNK, KEPT, KEPT_LENGTH = 1 << 20, 200_000, 24


class RankQueue:
    """Buckets of list positions by rank under a two-level bitmap; find-first-set gives the lowest occupied rank."""

    def __init__(self, ranks: int) -> None:
        self.words = [0] * (ranks // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(position)
        else:
            self.load(rank, [position])

    def load(self, rank: int, positions: list[int]) -> None:
        """A new bucket."""
        self.buckets[rank] = positions
        self.words[rank >> 6] |= 1 << (rank & 63)
        self.top |= 1 << (rank >> 6)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions in order; the queue must not be empty (``top`` is not 0)."""
        at = (self.top & -self.top).bit_length() - 1
        word = self.words[at]
        rank = (at << 6) + (word & -word).bit_length() - 1
        self.words[at] = word & (word - 1)
        if not self.words[at]:
            self.top &= self.top - 1
        held = self.buckets.pop(rank)
        held.sort()
        return rank, held


class Bpe:
    """Merges of a byte-level vocabulary as arrays; ``path`` names its tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right = [ids[a] for a, _ in pairs], [ids[b] for _, b in pairs]
        self.merged = [ids[a + b] for a, b in pairs]
        # the byte alphabet: printable bytes stand for themselves, the others follow from U+0100 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.bytes = np.array([ids[shown[b]] for b in range(256)], dtype=np.int32)
        self.first = np.full((256, 256), -1, np.int32)  # ranks of pairs of bytes
        self.follow: dict[int, dict[int, int]] = {}  # left id: right id: rank
        self.lead: dict[int, dict[int, int]] = {}  # right id: left id: rank
        byte_of = {i: b for b, i in enumerate(self.bytes.tolist())}
        for rank, (a, b) in enumerate(zip(self.left, self.right)):
            self.follow.setdefault(a, {})[b] = rank
            self.lead.setdefault(b, {})[a] = rank
            if a in byte_of and b in byte_of:
                self.first[byte_of[a], byte_of[b]] = rank

    def merge(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all pieces one after another, and where each piece's ids begin (and the last end)."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(data)
        if not n:
            return [], [0] * (len(pieces) + 1)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        inner = ends[(ends > 0) & (ends < n)]
        after[inner - 1] = after[n - 1] = -1
        before[inner] = -1
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self.first[data[:-1], data[1:]]
        ranks[after < 0] = -1
        tok, nxt, prv = array("i", self.bytes[data].tobytes()), array("i", after.tobytes()), array("i", before.tobytes())
        queue = RankQueue(len(self.left))
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        cuts = [0, *(np.flatnonzero(np.diff(ranks[order])) + 1).tolist(), len(order)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                queue.load(int(ranks[order[x]]), order[x:y].tolist())
        left, right, merged, push = self.left, self.right, self.merged, queue.push
        while queue.top:
            rank, held = queue.pop()
            a, b, new = left[rank], right[rank], merged[rank]
            follow, lead = self.follow.get(new), self.lead.get(new)
            for p in held:
                if tok[p] != a:  # stale
                    continue
                q = nxt[p]
                if q < 0 or tok[q] != b:
                    continue
                tok[p], tok[q] = new, -1
                nxt[p] = r = nxt[q]
                if r >= 0:
                    prv[r] = p
                    if follow is not None and (found := follow.get(tok[r])) is not None:
                        push(found, p)
                if lead is not None and (r := prv[p]) >= 0 and (found := lead.get(tok[r])) is not None:
                    push(found, r)
        out = np.frombuffer(tok, dtype=np.int32)
        kept = out >= 0
        at = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[np.concatenate([[0], ends])]
        return out[kept].tolist(), at.tolist()


class Encoder:
    """Texts to ids; keeps the ids of about ``KEPT`` short units.

    A unit is a stretch between single blanks with the blank before it: such a blank, with no white space beside it, always
    begins a pre-token, so units are encoded apart.
    """

    def __init__(self, bpe: Bpe, pattern: str = PATTERN) -> None:
        self.bpe, self.split = bpe, regex.compile(pattern).findall
        self.odd = re.compile(r" (?:\s|$)").search
        self.forget()

    def forget(self) -> None:
        self.plain: dict[str, int] = {}  # a unit as it stands: its number
        self.blank: dict[str, int] = {}  # a unit without the blank before it: its number
        self.pieces: dict[str, list[int]] = {}
        self.pool, self.begin, self.size = array("i"), array("i"), array("i")  # ids by unit number

    @staticmethod
    def _glued(text: str) -> list[str]:
        units: list[str] = []
        for i, part in enumerate(text.split(" ")):
            if i and (not part or part[0].isspace() or not units[-1] or units[-1][-1].isspace()):
                units[-1] += " " + part
            else:
                units.append(" " + part if i else part)
        return units

    def _parts(self, unit: str, before: str) -> list[str]:
        if unit.isalpha():
            return [before + unit]
        if unit[-1:] in ENDS and unit[:-1].isalpha():
            return [before + unit[:-1], unit[-1]]
        return self.split(before + unit)

    def _learn(self, known: dict[str, int], units: set[str], before: str) -> None:
        fresh = [u for u in units if u not in known]
        parts = [self._parts(u, before) for u in fresh]
        ids_of = self.pieces
        new = list({p for ps in parts for p in ps if p not in ids_of})
        ids, at = self.bpe.merge(new)
        ids_of.update(zip(new, [ids[a:b] for a, b in zip(at, at[1:])]))
        for u, ps in zip(fresh, parts):
            known[u] = len(self.begin)
            self.begin.append(len(self.pool))
            for p in ps:
                self.pool.extend(ids_of[p])
            self.size.append(len(self.pool) - self.begin[-1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (and the last end)."""
        if len(self.begin) > KEPT or len(self.pieces) > KEPT or len(self.pool) > KEPT * KEPT_LENGTH // 2:
            self.forget()
        plain, blank, odd = self.plain, self.blank, self.odd
        heads, tails = [], []
        for t in texts:
            if odd(t):
                heads.append(self._glued(t))
                tails.append(())
            else:
                parts = t.split(" ")
                heads.append(parts[:1])
                del parts[0]
                tails.append(parts)
        units = set(chain.from_iterable(heads)), set(chain.from_iterable(tails))
        long = [[u for u in us if len(u) > KEPT_LENGTH] for us in units]
        for us, drop in zip(units, long):
            us.difference_update(drop)
        self._learn(plain, units[0], "")
        self._learn(blank, units[1], " ")
        kept = len(self.begin), len(self.pool)
        self._learn(plain, set(long[0]), "")
        self._learn(blank, set(long[1]), " ")
        rows = chain.from_iterable(chain(map(plain.__getitem__, h), map(blank.__getitem__, t)) for h, t in zip(heads, tails))
        counts = np.array([len(h) + len(t) for h, t in zip(heads, tails)], dtype=np.int64)
        number = np.fromiter(rows, np.int64, int(counts.sum()))
        size = np.array(self.size, np.int32)[number].astype(np.int64)
        ends = np.cumsum(size)
        flat = np.array(self.pool, np.int32)[np.repeat(np.array(self.begin, np.int32)[number] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        for known, us in zip((plain, blank), long):  # long units are rarely met again
            for u in us:
                del known[u]
        del self.begin[kept[0] :], self.size[kept[0] :], self.pool[kept[1] :]
        return flat, at


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(Bpe(path))


def encode_corpus(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``(key, ids)``: one row per row of ``df``, ids without special tokens.

    ``path`` names the vocabulary (tokenizers JSON, byte-level BPE) on every executor. A null or an empty text has an
    empty list; strings that look like special tokens are ordinary text; repeated rows stay repeated. Only ``key`` and
    ``text`` are read. There is no shuffle beyond spreading a scan of very few files.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(map(len, texts), CHUNK):
                flat, at = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), lists], names=[key, "ids"])

    return spread(df, [key, text]).mapInArrow(run, f"{key} {kind}, ids array<int>").select(key, F.col("ids"))
