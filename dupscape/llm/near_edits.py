"""Near-duplicate texts: weighted dart signatures, banded candidate joins, exact verification.

DartMinHash (Christiani, 2020): every element of a set owns a deterministic Poisson field of darts over the plane
weight x rank, drawn region by region from hashes of (element, weight region, rank region). A set of total weight W
keeps the darts that lie below its elements' weights and below the rank t / W, so that about t darts remain whatever
the set's size. Each dart falls into one of k coordinates, and the dart of lowest rank wins the coordinate. Two sets
agree in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscape.llm.lookalikes import comparable, slices
from dupscape.operators.skew import salted_pairs, skewed_join
from dupscape.session import materialize, spread, width

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
_CUTS = (_POISSON * 2.0**64).clip(max=2.0**64 - 4096).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def char_runs(cps: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` code points."""
    if len(cps) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(cps) - size + 1, np.uint64)
        for i in range(size):
            h = mix(h + cps[i : len(cps) - size + 1 + i].astype(np.uint64))
    return np.unique(h)


def word_runs(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; a shorter text is one run of all its words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in words], dtype=np.uint64)
    return char_runs64(ids, min(size, len(ids)))


def char_runs64(ids: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(ids) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = mix(h + ids[i : len(ids) - size + 1 + i])
    return np.unique(h)


def dart_signature(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """``k`` coordinates of a weighted set of distinct 64-bit elements; coordinates no dart reached are 0.

    Weights are positive; None stands for 1 throughout. An empty set has zeros only.
    """
    out = np.zeros(k, np.uint64)
    if not len(elements):
        return out
    total = float(len(elements) if weights is None else weights.sum())
    limit = k * (math.log(k) + 3) / total
    units = np.ones(len(elements), np.int64) if weights is None else np.ceil(weights).astype(np.int64)
    ranks = math.ceil(limit)
    with np.errstate(over="ignore"):
        which = np.repeat(np.arange(len(elements)), units)
        unit = np.arange(len(which)) - np.repeat(np.cumsum(units) - units, units)
        region = mix(elements[which] ^ mix(unit.astype(np.uint64)))
        seeds = mix(region[:, None] + mix(np.arange(1, ranks + 1, dtype=np.uint64))[None, :])
        n = np.searchsorted(_CUTS, mix(seeds.ravel() ^ np.uint64(0x5851F42D4C957F2D)), side="right")
        cell = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(seeds.ravel()[cell] + mix(number.astype(np.uint64) + np.uint64(977)))
    rank = cell % ranks + mix(dart ^ np.uint64(1)) / 2.0**64
    keep = rank <= limit
    if weights is not None:
        owner = cell // ranks
        keep &= unit[owner] + mix(dart ^ np.uint64(2)) / 2.0**64 <= weights[which[owner]]
    dart, rank = dart[keep], rank[keep]
    at = (mix(dart ^ np.uint64(3)) % np.uint64(k)).astype(np.int64)
    order = np.argsort(-rank, kind="stable")
    out[at[order]] = dart[order] | np.uint64(1)  # of equal coordinates the last, lowest rank stays
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = mix(np.arange(bands, dtype=np.uint64) + np.uint64(31))
    parts = signature[: bands * rows].reshape(bands, rows)
    with np.errstate(over="ignore"):
        for i in range(rows):
            h = mix(h + parts[:, i])
    return h.view(np.int64)


def missed(similarity: float, bands: int, rows: int) -> float:
    """Probability that a pair of the given similarity shares no band."""
    return (1 - similarity**rows) ** bands


def _forms(df: DataFrame, key: str, text: str, words: bool) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(map(len, texts), 1 << 21):
                if words:
                    forms = [" ".join(t.split()).lower() for t in texts[a:b]]
                else:
                    cps, at = comparable(texts[a:b])
                    whole = cps.astype("<u4").tobytes()
                    forms = [whole[4 * at[i] : 4 * at[i + 1]].decode("utf-32-le", "surrogatepass") for i in range(b - a)]
                digests = [hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=16).digest() for f in forms]
                out = pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(digests, pa.binary()), pa.array(forms, pa.string())], names=[key, "digest", "form"])
                yield out.filter(pa.array([bool(f) for f in forms]))

    rows = spread(df.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()))
    return rows.mapInArrow(run, f"{key} {kind}, digest binary, form string")


def _runs(words: bool, size: int) -> Callable[[str], np.ndarray]:
    if words:
        return lambda form: word_runs(form, size)
    return lambda form: char_runs(np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32), size)


def near_duplicate_classes(
    df: DataFrame, key: str, text: str, *, unit: str = "words", size: int = 5, threshold: float = 0.8, bands: int = 64, rows: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts and the links between different ones, over all rows.

    Returns ``members(key, digest)``, one row per record with a non-empty compared text, and ``links(digest_a, digest_b,
    similarity)`` between classes whose exact Jaccard similarity of distinct runs reaches ``threshold``. ``unit`` is
    ``words`` (runs of ``size`` lower-cased words) or ``chars`` (runs of ``size`` letters and digits of the one look-alike
    form, in lower case). Texts shorter than one run of characters are linked with equal texts only.

    Candidates share a band of ``rows`` coordinates of a dart signature; a pair of similarity s is missed with
    probability ``missed(s, bands, rows)``. Equal texts are one class before signatures are made, so a text copied into a
    third of all rows costs one signature; crowded bands are salted. Null and empty texts have no class.
    """
    words = unit == "words"
    forms = materialize(_forms(df, key, text, words), "forms")
    distinct = forms.repartition(width(df.sparkSession), "digest").groupBy("digest").agg(F.first("form").alias("form"))
    runs, k = _runs(words, size), bands * rows

    def sign(batches):
        for batch in batches:
            digests, keys, counts, n = batch.column(0), [], [], []
            for form in batch.column(1).to_pylist():
                elements = runs(form)
                n.append(len(elements))
                if len(elements):
                    keys.append(band_hashes(dart_signature(elements, None, k), bands, rows))
                counts.append(bands if len(elements) else 0)
            index = np.repeat(np.arange(len(n)), counts)
            yield pa.RecordBatch.from_arrays(
                [digests.take(pa.array(index)), pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(np.array(n, np.int32)[index], pa.int32())],
                names=["digest", "band", "n"],
            )

    reps = materialize(distinct, "texts")
    banded = materialize(spread(reps, ["digest", "form"]).mapInArrow(sign, "digest binary, band bigint, n int"), "bands")
    pairs = salted_pairs(banded, ["band"], "digest", ["n"])
    candidates = pairs.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")).select("digest_a", "digest_b").distinct()
    a = reps.select(F.col("digest").alias("digest_a"), F.col("form").alias("form_a"))
    b = reps.select(F.col("digest").alias("digest_b"), F.col("form").alias("form_b"))

    def verify(batches):
        for batch in batches:
            score, last = [], (None, None)
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if last[0] != x:
                    last = (x, runs(x))
                other = runs(y)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                score.append(both / (len(last[1]) + len(other) - both))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["digest_a", "digest_b", "similarity"])
            yield out.filter(pa.array([s >= threshold for s in score], pa.bool_()))

    candidates = candidates.repartition(width(df.sparkSession), "digest_a")
    held = candidates.join(a, "digest_a").join(b, "digest_b").select("digest_a", "digest_b", "form_a", "form_b")
    links = held.mapInArrow(verify, "digest_a binary, digest_b binary, similarity double")
    return forms.select(key, "digest"), links


def near_duplicate_pairs(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """All record pairs ``(first, second)`` behind the classes and links of :func:`near_duplicate_classes`.

    The result itself is quadratic in the size of a class; use the classes where that matters.
    """
    members, links = near_duplicate_classes(df, key, text, **options)
    members = materialize(members.distinct(), "members")
    same = salted_pairs(members, ["digest"], key).select(F.col(f"{key}_a").alias("first"), F.col(f"{key}_b").alias("second"))
    links = materialize(links.select("digest_a", "digest_b"), "links")
    left = members.select(F.col("digest").alias("digest_a"), F.col(key).alias("x"))
    right = members.select(F.col("digest").alias("digest_b"), F.col(key).alias("y"))
    one = skewed_join(left, links, ["digest_a"], ["x"])
    cross = skewed_join(right, one, ["digest_b"], ["y"]).select(F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"))
    return same.unionByName(cross).where("first <> second").distinct()


def near_duplicates(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """One row per record: ``(key, class_id, copies, links)``; ``links`` counts the other classes linked with its class."""
    members, links = near_duplicate_classes(df, key, text, **options)
    ends = links.select(F.explode(F.array("digest_a", "digest_b")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("links"))
    members = materialize(members.distinct(), "members")
    sizes = members.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).join(ends, "digest", "left")
    joined = skewed_join(members, sizes, ["digest"], [key])
    return joined.select(key, F.lower(F.hex("digest")).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
