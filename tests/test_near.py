"""Near hashes: exact against brute force, and pairs that are not near never reach a disk."""

import os
import random
from collections import Counter

import __spark_entry__ as entry
from dupscape.operators import images
from dupscape.session import shared_dir


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def files(spark):
    """Bytes by file of what Spark's shuffles and the shared folder hold."""
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {os.path.join(r, f): os.path.getsize(os.path.join(r, f)) for d in [*dirs, shared_dir(spark).removeprefix("file:")] for r, _, names in os.walk(d) for f in names}


def test_near_hashes_equal_brute_force_also_where_crowded(spark, rows):
    rng = random.Random(4)
    bases = [rng.getrandbits(64) for _ in range(4)]
    made = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(400):
        v = rng.choice(bases)
        for b in rng.sample(range(64), rng.randint(0, 9)):
            v ^= 1 << b
        made.add(v)
    made |= {bases[0] ^ v for v in range(300)}  # one long run of a key
    made = sorted(map(signed, made))
    df = spark.createDataFrame([(v,) for v in [*made, *made[:50], None]], "hash bigint")
    away = {(x, y): ((x ^ y) % (1 << 64)).bit_count() for i, x in enumerate(made) for y in made[i + 1 :]}
    for t, block in ((1, 100_000), (8, 50), (12, 100_000)):
        want = sorted(((x, y, d) for (x, y), d in away.items() if d <= t), key=str)
        assert rows(images.near_hashes(df, t, block), "x", "y", "distance") == want


def test_q28_pairs_that_are_not_near_stay_in_their_task(spark):
    rng = random.Random(0)  # no others are near by chance
    data = []
    for i in range(1500):  # all agree in 8 bits
        hashes = [signed(rng.getrandbits(56) << 8) for _ in range(2)]
        data.append((f"/{i:04d}", hashes, 120.0, 20.0))
        if i % 100 == 0:  # a near one in another hash, the same one, and one with an equal hash that is brighter and flat
            data += [(f"/{i:04d}n", [signed(rng.getrandbits(64)), hashes[0] ^ 31], 121.0, 20.0), (f"/{i:04d}s", hashes, 120.0, 20.0), (f"/{i:04d}x", hashes, 200.0, 1.0)]
    df = spark.createDataFrame(data, "path string, hashes array<bigint>, mean double, deviation double")
    before = files(spark)
    got = {(r.rep_path, r.path, r.distance) for r in images.similar_image_groups(df).collect()}
    written = sum(n for f, n in files(spark).items() if f not in before)
    assert got == {(f"/{i:04d}", f"/{i:04d}{end}", d) for i in range(0, 1500, 100) for end, d in (("", 0), ("n", 5), ("s", 0))}
    assert written < 10_000_000


def hamming_query(spark, tmp_path, name, threshold):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefgh", k=36)) + "a" * 36 for _ in range(1500)]  # all agree in 32 bits
    docs = [(i, t) for i, t in enumerate([*texts, *texts[:9], "", None])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sign = lambda g: sum((g[r * 9 + c] > g[r * 9 + c + 1]) << 63 - r * 8 - c for r in range(8) for c in range(8))
    made = sorted(set(map(sign, texts)))
    away = Counter((x ^ y).bit_count() for i, x in enumerate(made) for y in made[i + 1 :])
    before = files(spark)
    got = {r.distance: r.pairs for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    written = sum(n for f, n in files(spark).items() if f not in before)
    assert got == {d: n for d, n in away.items() if d <= threshold} and threshold in got
    assert written < 5_000_000


def test_q27_pairs_that_are_not_near_stay_in_their_task(spark, tmp_path):
    hamming_query(spark, tmp_path, "q27_hamming_pairs", 4)


def test_q27d_pairs_that_are_not_near_stay_in_their_task(spark, tmp_path):
    hamming_query(spark, tmp_path, "q27d_hamming_pairs", 8)
