"""One stored form for text that looks the same.

Look-alike classes are the connected components (union-find) of a graph whose nodes are code points and short
strings: a code point is joined with its wide, narrow, font, ligature or presentation-form decomposition, with its
canonical decomposition, and with the letters of other scripts drawn alike. Each class gets one representative,
the member most frequent in the corpus at hand. Text is rewritten greedily: single code points through the
automaton's one-symbol transitions, kept as a dense table, longer patterns (a letter and its combining marks,
conjoining jamo) with a leftmost-longest Aho-Corasick automaton.

Kept apart, because they do not look the same: case, accents, other punctuation, superscripts, circled or
fractional forms, line breaks, and the number of blanks.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscape.session import spread

# Letters of different scripts that are drawn alike. Each string is one class.
ALIKE = (
    "AΑАᎪ", "BΒВᏴ", "CСᏟϹ", "DᎠ", "EΕЕᎬ", "FϜ", "GԌᏀ", "HΗНᎻ", "IΙІӀᏆ", "JЈᎫ", "KΚКᏦ", "LᏞ", "MΜМᎷϺ", "NΝ", "OΟОՕ",
    "PΡРᏢ", "QԚ", "SЅᏚՏ", "TΤТᎢ", "UՍ", "VѴᏙ", "WԜᎳ", "XΧХ", "YΥҮ", "ZΖᏃ", "aаɑ", "cсϲ", "dԁ", "eе", "gɡ", "hһ", "iі",
    "jјϳ", "lӏ", "oοоօ", "pρр", "qԛ", "sѕ", "uս", "vνѵ", "wԝ", "xх", "yуү", "ΓГ", "ΠП", "ΦФ", "э϶",
    "-‐‑⁃", "··∙⋅", "'ʼ", "λᴧ", "ƷӠ", "əә", "ƏӘ", "θѳ", "ÆӔ", "æӕ",
)

#: Compatibility decompositions whose two sides look the same.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<small>"}
#: Format characters that are drawn.
DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Greek symbol variants: their decompositions are drawn differently.
VARIANTS = {*range(0x3D0, 0x3D7), *range(0x3F0, 0x3FA)}
TOP = 0x110000
SURROGATES = range(0xD800, 0xE000)
#: Where assigned code points with decompositions, case or zero width lie; the rest is private, unassigned or plain.
ASSIGNED = (*range(0x80, 0xD800), *range(0xF900, 0x17000), *range(0x1AFF0, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200))


class UnionFind:
    """Disjoint sets over any hashable nodes, with path halving."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[b] = a

    def classes(self) -> list[list]:
        out = defaultdict(list)
        for x in self.up:
            out[self.find(x)].append(x)
        return list(out.values())


def invisible(cp: int) -> bool:
    """Zero-width code points: format characters, variation selectors, the grapheme joiner, tags."""
    if cp in DRAWN:
        return False
    return unicodedata.category(chr(cp)) == "Cf" or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0100 <= cp <= 0xE01EF


def blank(cp: int) -> bool:
    """Blanks of other kinds than U+0020: all space separators."""
    return cp != 0x20 and unicodedata.category(chr(cp)) == "Zs"


@functools.cache
def _graph() -> tuple[UnionFind, tuple[int, ...], dict[int, str]]:
    """Classes of code points, the invisible ones, and the code points that stand for longer strings."""
    sets, hidden, longer = UnionFind(), [], {}
    for group in ALIKE:
        for other in group[1:]:
            sets.union(group[0], other)
    for cp in ASSIGNED:
        if 0x3400 <= cp < 0xA000 or cp in VARIANTS:
            continue
        ch = chr(cp)
        if invisible(cp):
            hidden.append(cp)
        elif blank(cp):
            sets.union(" ", ch)
        elif found := unicodedata.decomposition(ch):
            tag = found.split(" ", 1)[0]
            if tag[0] != "<":
                to = unicodedata.normalize("NFD", ch)
            elif tag in SAME_LOOK:
                to = "".join(chr(int(x, 16)) for x in found.split()[1:])
                to = to if to[0] == " " else unicodedata.normalize("NFKD", to)
            else:
                continue
            if to[0] == " ":  # a spacing accent, which is not drawn like a blank and an accent
                continue
            if len(to) == 1:
                sets.union(to, ch)
            else:
                longer[cp] = to
    return sets, tuple(hidden), longer


def _rank(ch: str) -> tuple[bool, int]:
    """Order among members of a class without counts: those that are no compatibility form, then by code point."""
    return unicodedata.normalize("NFKC", ch) != ch, ord(ch)


class Folding:
    """A rewriting to representatives; ``counts`` are the corpus' code point frequencies.

    Without counts the representative is the smallest code point of its class that is no compatibility form. A class that holds a longer string is
    represented by that string, each of its code points by its own representative, so that rewriting is confluent.
    """

    def __init__(self, counts: Mapping[int, int] | None = None, caseless: bool = False) -> None:
        counts = counts or {}
        sets, hidden, longer = _graph()
        self.first = np.arange(TOP, dtype=np.uint32)
        self.size = np.ones(TOP, dtype=np.uint8)
        self.long: dict[int, np.ndarray] = {}
        base: dict[str, str] = {}
        for members in sets.classes():
            if " " in members:
                to = " "
            else:
                to = min(members, key=lambda c: (-counts.get(ord(c), 0), _rank(c)))
            base |= dict.fromkeys(members, to)
        one = lambda s: unicodedata.normalize("NFC", "".join(base.get(c, c) for c in s))
        canonical: dict[str, list[int]] = defaultdict(list)
        targets = {ord(c): to for c, to in base.items()} | {cp: one(to) for cp, to in longer.items()}
        for cp, to in targets.items():
            canonical[to].append(cp)
        for to, members in canonical.items():
            if len(to) == 1 and ord(to) in targets and len(members) > 1 and to not in base:
                best = min([ord(to), *members], key=lambda c: (-counts.get(c, 0), _rank(chr(c))))
                if unicodedata.is_normalized("NFC", chr(best)):
                    for cp in members:
                        targets[cp] = chr(best)
        if caseless:
            targets = self._caseless(targets)
        for cp, to in targets.items():
            self._set(cp, to)
        for cp in hidden:
            self._set(cp, "")
        marks = np.zeros(TOP, dtype=bool)
        for cp in ASSIGNED:
            if unicodedata.combining(chr(cp)) or 0x1100 <= cp < 0x1200:
                marks[cp] = True
        self.marks = marks
        self.ascii_same = bool((self.first[:128] == np.arange(128)).all() and (self.size[:128] == 1).all())
        self._automaton = None

    def _set(self, cp: int, to: str) -> None:
        self.size[cp] = len(to)
        if len(to) == 1:
            self.first[cp] = ord(to)
        elif len(to) > 1:
            self.first[cp] = ord(to[0])
            self.long[cp] = np.array([ord(c) for c in to], dtype=np.uint32)

    @staticmethod
    def _caseless(targets: dict[int, str]) -> dict[int, str]:
        """Lower case, then classes closed over both cases: capital look-alikes join their small letters too."""
        sets = UnionFind()
        for cp in (*range(0x41, 0x80), *ASSIGNED):
            ch = chr(cp)
            to, low = targets.get(cp, ch), ch.lower()
            if len(to) == 1 and (cp in targets or low != ch):
                sets.union(to, ch)
                if len(to.lower()) == 1:
                    sets.union(to.lower(), to)
                if len(low) == 1 and (ord(low) not in targets or targets[ord(low)] == low):
                    sets.union(low, ch)
        out = {}
        small = {}
        for members in sets.classes():
            low = [m for m in members if m.lower() == m] or members
            small |= dict.fromkeys(members, min(low, key=_rank))
        for cp in {*targets, *(ord(c) for c in small)}:
            ch = chr(cp)
            to = small[ch] if ch in small else targets[cp].lower()
            out[cp] = "".join(small.get(c, c) for c in to)
        return out

    @property
    def automaton(self):
        """Patterns of more than one code point: every composed letter's marks, in canonical order."""
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for cp in ASSIGNED:
                if 0x3400 <= cp < 0xA000 or 0xF900 <= cp < 0xFB00:
                    continue
                ch = chr(cp)
                apart = unicodedata.normalize("NFD", ch)
                if len(apart) > 1 and unicodedata.normalize("NFC", apart) == ch:
                    found.add_word(apart, (len(apart), ch))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def _compose(self, text: str) -> str:
        text, out, at = unicodedata.normalize("NFD", text), [], 0
        for end, (length, to) in self.automaton.iter_long(text):
            out += text[at : end - length + 1], to
            at = end + 1
        return "".join([*out, text[at:]])

    def _table(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rewritten code points, and the number that each input code point became."""
        size = self.size[cps]
        if (size == 1).all():
            return self.first[cps], size
        out = np.repeat(self.first[cps], size)
        where = np.flatnonzero(size > 1)
        if len(where):
            start = np.cumsum(size, dtype=np.int64) - size
            for i in where:
                to = self.long[int(cps[i])]
                out[start[i] : start[i] + len(to)] = to
        return out, size

    def codes(self, text: str) -> np.ndarray:
        cps = points(text)
        if self.marks[cps].any() or self.marks[out := self._table(cps)[0]].any():
            kept = text_of(cps[self.size[cps] > 0])
            out = self._table(points(self._compose(text_of(self._table(points(self._compose(kept)))[0]))))[0]
        return out

    def fold(self, text: str) -> str:
        """The one stored form of ``text``; an empty text stays empty."""
        if text.isascii() and self.ascii_same:
            return text
        return text_of(self.codes(text))

    def batch(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' folded code points in one array, and the offsets of the texts in it."""
        texts = list(texts)
        joined = "".join(texts)
        cps = points(joined)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        out, size = self._table(cps)
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        offsets = at[np.concatenate([[0], ends])]
        hit = np.flatnonzero(self.marks[out])
        if not len(hit):
            return out, offsets
        parts, sizes = [], []
        bad = set(np.searchsorted(offsets, hit, side="right") - 1)
        for i in range(len(texts)):
            part = self.codes(texts[i]) if i in bad else out[offsets[i] : offsets[i + 1]]
            parts.append(part)
            sizes.append(len(part))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def text_of(cps: np.ndarray) -> str:
    return np.ascontiguousarray(cps, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


@functools.cache
def default_folding() -> Folding:
    return Folding()


@functools.cache
def comparing_folding() -> Folding:
    """For comparisons without case: look-alikes of either case fall together."""
    return Folding(caseless=True)


@functools.cache
def letters_and_digits() -> np.ndarray:
    out = np.zeros(TOP, dtype=bool)
    for cp in (*range(0x80), *ASSIGNED):
        kind = unicodedata.category(chr(cp))
        out[cp] = kind[0] == "L" or kind == "Nd"
    out[0x17000:0x1AFF0] = out[0x20000:0x2F800] = out[0x30000:0x33480] = True
    return out


SPECIAL = np.uint32(0xFFFFFFFF)


@functools.cache
def _comparable_table() -> np.ndarray:
    """Code point to compared code point; 0: dropped; SPECIAL: its text takes the longer way."""
    f = comparing_folding()
    out = np.where((f.size == 1) & letters_and_digits()[f.first], f.first, 0).astype(np.uint32)
    out[(f.size > 1) | f.marks | f.marks[f.first]] = SPECIAL
    return out


def comparable(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one form, lower case, letters and digits only: code points of all, and offsets."""
    texts = list(texts)
    out = _comparable_table()[points("".join(texts))]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    keep = out != 0
    at = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])
    offsets, kept = at[ends].astype(np.int64), out[keep]
    hit = np.flatnonzero(kept == SPECIAL)
    if not len(hit):
        return kept, offsets
    f, letters = comparing_folding(), letters_and_digits()
    bad, parts, done = np.unique(np.searchsorted(offsets, hit, side="right") - 1), [], 0
    sizes = np.diff(offsets)
    for i in bad:
        part = f.codes(texts[i])
        part = part[letters[part]]
        parts += kept[offsets[done] : offsets[i]], part
        sizes[i], done = len(part), i + 1
    parts.append(kept[offsets[done] :])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def slices(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with about ``most`` characters each, one row at least."""
    begin, total, end = 0, 0, 0
    for n in lengths:
        if end > begin and total + n > most:
            yield begin, end
            begin, total = end, 0
        end, total = end + 1, total + n
    if end > begin:
        yield begin, end


def code_point_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(cp, n)`` over the named text columns; each task sends one row per code point it met."""

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for column in batch.columns:
                texts = [t for t in column.to_pylist() if t]
                for a, b in slices(map(len, texts), 1 << 21):
                    cps, n = np.unique(points("".join(texts[a:b])), return_counts=True)
                    total.update(dict(zip(cps.tolist(), n.tolist())))
        yield pa.RecordBatch.from_pydict({"cp": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    return spread(df, columns).mapInArrow(count, "cp int, n bigint").groupBy("cp").agg(F.sum("n").alias("n"))


def corpus_folding(df: DataFrame, columns: list[str]) -> Folding:
    """A folding whose representatives are the corpus' most frequent; at most one row per code point reaches the driver."""
    return Folding({r.cp: r.n for r in code_point_counts(df, columns).collect()})
