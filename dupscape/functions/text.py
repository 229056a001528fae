"""Text normalisation and fingerprints for names and contents."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType

# Marks of a copy at the end of a name, and the rolling hash of 18 symbols winnowed over 48 hashes.
COPY_SUFFIX = r"(?i)(?:\s*[-_ ]?(?:copy|副本|重复|备份|\(\d+\)|（\d+）))+$"
HASH_BASE, SYMBOLS, WINNOW = 1_099_511_628_211, 18, 48
#: Text shorter than this is no content to compare.
READY_LENGTH = 200


@pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no built-in. Null stays null."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def _without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _squeezed(value: Column) -> Column:
    return F.regexp_replace(value, r"[\s\p{Z}\p{P}]+", "")


def name_key(name: Column, compose: bool = True) -> Column:
    """A file name's comparable key: one extension off, NFKC, lower case, copy marks off, no white space or punctuation.

    ``compose=False`` leaves NFKC out and stays in the JVM, for names that are in that form.
    """
    bare = _without_extension(name)
    bare = nfkc(bare) if compose else bare
    return _squeezed(F.regexp_replace(F.lower(bare), COPY_SUFFIX, ""))


def prefilter_key(name: Column, compose: bool = True) -> Column:
    """The key that selects candidates for content: copy marks go before NFKC and lower case, and two extensions."""
    bare = F.regexp_replace(_without_extension(_without_extension(name)), COPY_SUFFIX, "")
    bare = nfkc(bare) if compose else bare
    return _squeezed(F.lower(bare))


def grams(key: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` characters; a shorter key is its own only gram, an empty one has none."""
    count = F.length(key) - (size - 1)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(key, i, F.lit(size))))
    return F.when(key == "", F.array().cast("array<string>")).when(count < 1, F.array(key)).otherwise(runs)


def strip_markup(markup: Column) -> Column:
    """Scripts and styles to a blank, tags to line ends, then the five basic entities, one after another."""
    text = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", "\n")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def normalize_text(text: Column, compose: bool = True) -> Column:
    """Extracted text in one line: NFKC, lines that hold only a page number off, white space single, ends trimmed."""
    text = nfkc(text) if compose else text
    text = F.regexp_replace(text, r"(?m)^[ \t]*\d{1,5}[ \t]*$", " ")
    return F.regexp_replace(F.regexp_replace(text, r"[\s\p{Z}]+", " "), r"^ | $", "")


def text_state(text: Column, least: int = READY_LENGTH) -> Column:
    """``ready`` from ``least`` code points on, else ``tooShort``; a null text failed."""
    return F.when(text.isNull(), "failed").when(F.length(text) >= least, "ready").otherwise("tooShort")


def title(text: Column, fallback: Column) -> Column:
    """The first line, if it has 2 to 100 characters, else the fallback."""
    line = F.trim(F.substring_index(text, "\n", 1))
    return F.when(F.length(line).between(2, 100), line).otherwise(fallback)


def symbols(text: Column) -> Column:
    """What is hashed: lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(text), r"[\s\p{Z}\p{P}]+", "")


def _rolling(codes: np.ndarray) -> np.ndarray:
    """Hash of the ``SYMBOLS`` symbols that end at each position from the ``SYMBOLS``-th on, modulo 2^64."""
    with np.errstate(over="ignore"):
        n = len(codes) - SYMBOLS + 1
        out = np.zeros(n, np.uint64)
        for i in range(SYMBOLS):
            out = out * np.uint64(HASH_BASE) + codes[i : n + i]
    return out


def winnowed(text: str) -> np.ndarray:
    """Sorted distinct minima of every ``WINNOW`` successive hashes; the last hash of a shorter text; none below 18 symbols."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    if len(codes) < SYMBOLS:
        return np.zeros(0, np.uint64)
    hashes = _rolling(codes)
    if len(hashes) < WINNOW:
        return hashes[-1:]
    # minima over power-of-two spans, two of which cover a window: linear memory for texts of any length
    span, low = 1, hashes
    while span * 2 <= WINNOW:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = WINNOW - span
    return np.unique(np.minimum(low[: len(hashes) - WINNOW + 1], low[rest:]) if rest else low)


@pandas_udf(ArrayType(LongType()))
def winnow(texts: pd.Series) -> pd.Series:
    """Fingerprints of each text as signed 64-bit patterns, compared unsigned while winnowing. Null gives null."""
    return texts.map(lambda t: winnowed(t).view(np.int64).tolist(), na_action="ignore")


def evidence(first: Column, second: Column, delimiter: str = "[。；]", least: int = 24, most: int = 3) -> Column:
    """Up to ``most`` excerpts of ``first`` that ``second`` holds too, case ignored: parts of 24 characters or more, cut to 100."""
    parts = F.transform(F.filter(F.split(first, delimiter), lambda p: F.length(p) >= least), lambda p: F.trim(F.substring(p, 1, 100)))
    low = F.lower(second)
    return F.slice(F.array_distinct(F.filter(parts, lambda p: (p != "") & low.contains(F.lower(p)))), 1, most)


def classification(similarity: Column, first: Column, second: Column) -> Column:
    """``high``, ``much`` or ``partial``, by similarity and the lesser coverage."""
    return F.when((similarity >= 0.82) & (F.least(first, second) >= 0.72), "high").when(similarity >= 0.58, "much").otherwise("partial")
