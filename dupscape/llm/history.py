"""New batches checked against everything accepted before, without reading all of it again.

Each record has fingerprints of its content. A partitioned Bloom filter holds them: each fingerprint sets a few bits of
one 64-bit word, and words are parted by hash, so building, probing and storing them are joins and aggregations of
narrow rows that grow no driver or task. What the filter lets pass is looked up in the fingerprint store by the full
key, which verifies the coverage that both records share. Filter and store are then extended by the batch.

:func:`known_records` and :func:`overlapping_records` check many batches at once, each against those before it;
:class:`FileHistory` and :class:`TextHistory` keep filter and store in a folder and take one batch after another.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscape.functions.text import symbols, winnow
from dupscape.operators.skew import skewed_join
from dupscape.session import materialize

#: Bytes that a sample covers: below, the sample is the whole file.
SAMPLED = 196_608
#: Bits that a fingerprint sets in its word; fingerprints for which one word is meant.
BITS, PER_WORD = 4, 6


def usable_hash(value: Column) -> Column:
    """The 64 lower-case hex digits of a complete SHA-256, however it is written; null for anything else.

    White space, a leading algorithm name or 0x, and separators between digits are dropped. One digit repeated is unusable.
    """
    digits = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(value, r"\s+", ""))), r"^(sha-?256[:=]?|0x)", ""), "[:-]", "")
    return F.when(digits.rlike(r"^[0-9a-f]{64}$") & ~digits.rlike(r"^(.)\1*$"), digits)


def file_fingerprints(files: DataFrame, record: str, batch: str, size: str, sample: str, full: str) -> DataFrame:
    """``(record, batch, kind, size, print)``: the whole content (exact) and, of large files, the sample (near).

    A sample of a file up to SAMPLED bytes covers it wholly and stands in for an unusable full hash. A null or zero
    size and an unusable hash give no fingerprint; rows with a null record or batch are left out.
    """
    s, f = usable_hash(F.col(sample)), usable_hash(F.col(full))
    whole = F.coalesce(f, F.when(F.col(size) <= SAMPLED, s))
    kinds = F.array(
        F.struct(F.lit("exact").alias("kind"), whole.alias("print")),
        F.struct(F.lit("near").alias("kind"), F.when(F.col(size) > SAMPLED, s).alias("print")),
    )
    rows = files.where(F.col(record).isNotNull() & F.col(batch).isNotNull() & (F.col(size) > 0))
    rows = rows.select(F.col(record).alias("record"), F.col(batch).alias("batch"), F.col(size).alias("size"), F.explode(kinds).alias("k"))
    return rows.select("record", "batch", "k.kind", "size", F.unhex("k.print").alias("print")).where("print is not null")


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64("kind", "size", "print"), F.lit(words))


def _mask() -> Column:
    h = F.xxhash64("print", "size", "kind")
    mask = F.lit(0).cast("bigint")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def store_rows(prints: DataFrame) -> DataFrame:
    """The store: per fingerprint and batch its smallest record, however many records share it."""
    return prints.groupBy("kind", "size", "print", "batch").agg(F.min("record").alias("earliest"))


def filter_rows(store: DataFrame, words: int) -> DataFrame:
    """The Bloom filter: one row a word, with the bits that each batch sets, as long as the batches that have any."""
    bits = store.select(_word(words).alias("word"), "batch", _mask().alias("bits")).groupBy("word", "batch").agg(F.expr("bit_or(bits)").alias("bits"))
    return bits.groupBy("word").agg(F.collect_list(F.struct("batch", "bits")).alias("held"))


def prescreened(new: DataFrame, bloom: DataFrame, words: int) -> DataFrame:
    """Store rows of which an earlier batch may hold the fingerprint; none that it holds is lost."""
    probes = new.withColumn("_w", _word(words)).withColumn("_m", _mask())
    before = F.aggregate(F.filter("held", lambda h: h["batch"] < F.col("batch")), F.lit(0).cast("bigint"), lambda s, h: s.bitwiseOR(h["bits"]))
    return probes.join(bloom.withColumnRenamed("word", "_w"), "_w").where(before.bitwiseAND(F.col("_m")) == F.col("_m")).drop("_w", "_m", "held")


def _best_records(prints: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(record, earlier, kind, coverage)`` of ``prints`` by the fingerprints that ``hits`` found; exact before near."""
    found = skewed_join(prints, hits, keys, ["record"])
    share = F.when(F.col("kind") == "exact", F.lit(1.0)).otherwise(F.lit(float(SAMPLED)) / F.col("size"))
    best = F.struct((F.col("kind") != "exact").alias("later"), F.col("earlier"), F.col("kind"), share.alias("coverage"))
    return found.groupBy("record").agg(F.min(best).alias("b")).select("record", "b.earlier", "b.kind", "b.coverage")


def known_records(prints: DataFrame, words: int | None = None) -> DataFrame:
    """``(record, earlier, kind, coverage)``: each record whose content an earlier batch holds, with the smallest such record.

    ``prints``, a table in files, may hold many batches; each is checked against the batches before it. Exact repeats win
    over near ones, one row a record. Fingerprints are first reduced to one row for each batch, so a content shared by a
    third of all rows is a handful of rows in the filter, the store and the lookup; only the last join meets its records,
    which are spread over tasks.
    """
    new = materialize(store_rows(prints), "store")
    words = words or max(64, new.count() // PER_WORD)
    passed = prescreened(new, filter_rows(new, words), words)
    old = new.select("kind", "size", "print", F.col("batch").alias("before"), F.col("earliest").alias("found"))
    hits = passed.drop("earliest").join(old, ["kind", "size", "print"]).where("before < batch").groupBy("kind", "size", "print", "batch").agg(F.min("found").alias("earlier"))
    return _best_records(prints, hits, ["kind", "size", "print", "batch"])


def text_fingerprints(texts: DataFrame, record: str, batch: str, text: str) -> DataFrame:
    """``(record, batch, prints)``: winnowed fingerprints of each text; texts too short for one have no row."""
    rows = texts.where(F.col(record).isNotNull() & F.col(batch).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(record).alias("record"), F.col(batch).alias("batch"), winnow(symbols(F.col(text))).alias("prints"))
    return rows.where(F.size("prints") > 0)


def _classed(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with equal fingerprints are one class: ``(record, batch, cls)`` and ``(cls, n, kind, size, print)``."""
    classed = materialize(texts.withColumn("cls", F.sha2(F.array_join(F.array_sort("prints"), ","), 256)), "text-prints")
    sets = classed.groupBy("cls").agg(F.first("prints").alias("prints")).withColumn("n", F.size("prints"))
    each = sets.select("cls", "n", F.explode("prints").alias("p"))
    each = each.select("cls", "n", F.lit("text").alias("kind"), F.lit(0).cast("bigint").alias("size"), F.to_binary(F.hex("p"), F.lit("hex")).alias("print"))
    return classed.select("record", "batch", "cls").distinct(), each


def _able(passed: DataFrame, each: Sequence[str], least: float) -> DataFrame:
    """Fingerprints that passed, of the classes that have enough of them left to reach ``least``."""
    able = passed.groupBy(*each, "n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= F.col("n") * (least - 1e-9)).select(*each)
    return passed.join(able, list(each), "left_semi")


def overlapping_records(texts: DataFrame, least: float = 0.8, block: int = 100_000) -> DataFrame:
    """``(record, earlier, coverage)``: each text of which a text of an earlier batch covers ``least`` or more of the fingerprints.

    ``texts`` is what :func:`text_fingerprints` gives; ``earlier`` is the smallest record with the greatest coverage. Texts with
    equal fingerprints are one class, so copies cost one lookup a batch. The Bloom filter drops the fingerprints that no
    earlier batch holds, and with them every class that has too few left to reach ``least``; the rest are looked up in
    the store, a fingerprint held by very many classes over several tasks, and the shared ones counted exactly.
    """
    members, each = _classed(texts)
    members = materialize(members, "members")
    held = members.groupBy("cls", "batch").agg(F.min("record").alias("earliest"))
    postings = materialize(skewed_join(members.select("cls", "batch").distinct(), each, ["cls"], ["batch"]), "postings")
    words = max(64, postings.count() // PER_WORD)
    passed = materialize(prescreened(postings, filter_rows(postings, words), words), "passed")
    new = _able(passed, ["cls", "batch"], least).select("cls", "n", "batch", "print").distinct()
    store = materialize(postings.select("print", F.col("cls").alias("other")).distinct(), "store")
    shared = skewed_join(store, new, ["print"], ["other"], block=block).groupBy("cls", "batch", "n", "other").agg(F.count(F.lit(1)).alias("shared"))
    covered = shared.withColumn("coverage", F.col("shared") / F.col("n")).where(F.col("coverage") >= least)
    old = held.select(F.col("cls").alias("other"), F.col("batch").alias("before"), "earliest")
    best = covered.join(old, "other").where("before < batch").groupBy("cls", "batch").agg(F.min(F.struct((-F.col("coverage")).alias("c"), F.col("earliest").alias("e"))).alias("b"))
    return skewed_join(members, best, ["cls", "batch"], ["record"]).select("record", F.col("b.e").alias("earlier"), (-F.col("b.c")).alias("coverage"))


class _Index:
    """Filter and store in a folder, both parted by the fingerprints' hash.

    The filter is one row a word, all batches' bits folded into it; the store keeps, a batch at a time, what no batch before
    held. A check reads the filter's parts that it probes, and of the store only the parts in which a probe passed; an
    update writes the store's new rows and the filter's touched parts, and counts with the manifest that names them, so
    that a batch taken in twice counts once and a failed one not at all. ``parts`` and ``words`` are fixed when the folder is
    made: ``words`` about a sixth of the fingerprints that it shall hold; more only raise the share looked up in vain.
    """

    #: Rows of passed fingerprints that are broadcast to the store's scan; more are shuffled with it.
    FEW = 1_000_000

    def __init__(self, spark: SparkSession, folder: str, words: int, parts: int = 64) -> None:
        self.spark, self.folder, self.words, self.parts = spark, folder.rstrip("/"), words, parts

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """Batches taken in, and the version of each part of the filter."""
        path, files = self._path("manifests")
        found = [int(f.getPath().getName().split(".")[0]) for f in files.listStatus(path) if f.getPath().getName().endswith(".json")] if files.exists(path) else []
        if not found:
            return {"version": 0, "batches": [], "filter": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{max(found)}.json").first().value)

    def _marked(self, rows: DataFrame) -> DataFrame:
        """Rows with the word that their fingerprint sets bits of, its part and the bits."""
        word = _word(self.words)
        return rows.select("*", word.alias("word"), F.pmod(word, F.lit(self.parts)).cast("int").alias("part"), _mask().alias("mask"))

    def _parts(self, rows: DataFrame) -> list[int]:
        return [r.part for r in rows.select("part").distinct().collect()]  # as many as the index has parts at most

    def filter(self, parts: Sequence[int]) -> DataFrame | None:
        versions = self.manifest()["filter"]
        paths = [f"{self.folder}/filter/version={versions[str(p)]}/part={p}" for p in parts if str(p) in versions]
        return self.spark.read.schema("word bigint, bits bigint").parquet(*paths) if paths else None

    def store(self, name: str, parts: Sequence[int] | None, schema: str) -> DataFrame:
        """Rows of ``name`` of all batches, or of some of its parts only."""
        batches = self.manifest()["batches"]
        if not batches:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(f"{schema}, batch int, part int").option("basePath", f"{self.folder}/{name}")
        rows = reader.parquet(*[f"{self.folder}/{name}/batch={b}" for b in batches])
        return (rows if parts is None else rows.where(F.col("part").isin(list(parts)))).drop("batch", "part")

    def passed(self, marked: DataFrame) -> DataFrame:
        """Rows of which the history may hold the fingerprint."""
        bloom = self.filter(self._parts(marked))
        if bloom is None:
            return marked.limit(0)
        return materialize(marked.join(bloom, "word").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).drop("bits"), "passed")

    def looked_up(self, passed: DataFrame, name: str, schema: str) -> DataFrame:
        """``passed`` joined with the store's rows of the same full key; the store is scanned, and shuffled only for very many."""
        rows = self.store(name, self._parts(passed), schema)
        few = passed.count() <= self.FEW
        return rows.join(F.broadcast(passed.drop("word", "part", "mask")) if few else passed.drop("word", "part", "mask"), ["kind", "size", "print"])

    def _take_in(self, batch: int, tables: dict[str, DataFrame], marked: DataFrame) -> None:
        last = self.manifest()
        version = last["version"] + 1
        for name, rows in tables.items():
            parted = rows if "part" in rows.columns else rows.withColumn("part", F.lit(0))
            parted.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{name}/batch={batch}")
        touched = self._parts(marked)
        bits = marked.select("word", F.col("mask").alias("bits"))
        old = self.filter(touched)
        folded = (bits if old is None else bits.unionByName(old)).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
        folded = folded.withColumn("part", F.pmod("word", F.lit(self.parts)).cast("int"))
        folded.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/filter/version={version}")
        state = {"version": version, "batches": sorted({*last["batches"], batch}), "filter": last["filter"] | {str(p): version for p in touched}}
        path, files = self._path(f"manifests/{version}.json.part")
        out = files.create(path, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not files.rename(path, self._path(f"manifests/{version}.json")[0]):
            raise OSError(f"batch {batch} could not be taken into {self.folder}")


class FileHistory(_Index):
    """History of file fingerprints: per fingerprint the smallest record, written again only by a batch with a smaller one."""

    ROWS = "kind string, size bigint, print binary, earliest bigint"

    def _hits(self, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Distinct fingerprints with their words, and those that the store holds: ``(kind, size, print, own, earlier)``."""
        marked = materialize(self._marked(store_rows(prints)), "new")
        found = self.looked_up(self.passed(marked).withColumnRenamed("earliest", "own"), "store", self.ROWS)
        return marked, materialize(found.groupBy("kind", "size", "print").agg(F.min("own").alias("own"), F.min("earliest").alias("earlier")), "hits")

    def check(self, prints: DataFrame) -> DataFrame:
        """``(record, earlier, kind, coverage)`` of one new batch, a table in files, as :func:`known_records` has it."""
        return _best_records(prints, self._hits(prints)[1].drop("own"), ["kind", "size", "print"])

    def update(self, prints: DataFrame, batch: int) -> None:
        """Take the batch in: fingerprints that are new, or whose record is smaller than any before."""
        if batch not in self.manifest()["batches"]:
            self._extend(*self._hits(prints.where(F.col("batch") == batch)), batch)

    def accept(self, prints: DataFrame, batch: int) -> DataFrame:
        """:meth:`check` of a batch not taken in yet, and :meth:`update` by it, with one probe and one lookup."""
        marked, hits = self._hits(prints)
        found = materialize(_best_records(prints, hits.drop("own"), ["kind", "size", "print"]), "found")
        self._extend(marked, hits, batch)
        return found

    def _extend(self, marked: DataFrame, hits: DataFrame, batch: int) -> None:
        old = hits.where("earlier <= own").select("kind", "size", "print")
        kept = marked.join(old, ["kind", "size", "print"], "left_anti").select("kind", "size", "print", "earliest", "part")
        self._take_in(batch, {"store": kept}, marked)


class TextHistory(_Index):
    """History of winnowed texts: postings of each class of equal fingerprints, and its smallest record."""

    ROWS, CLASSES = "kind string, size bigint, print binary, other string", "other string, earliest bigint"

    def check(self, texts: DataFrame, least: float = 0.8) -> DataFrame:
        """``(record, earlier, coverage)`` of one new batch, as :func:`overlapping_records` has it; its own texts do not count."""
        members, each = _classed(texts)
        passed = self.passed(self._marked(materialize(each, "new")))
        able = materialize(_able(passed, ["cls"], least), "able")
        shared = self.looked_up(able, "store", self.ROWS).groupBy("cls", "n", "other").agg(F.count(F.lit(1)).alias("shared"))
        covered = materialize(shared.withColumn("coverage", F.col("shared") / F.col("n")).where(F.col("coverage") >= least), "covered")
        classes = self.store("classes", None, self.CLASSES).join(covered.select("other").distinct(), "other", "left_semi").groupBy("other").agg(F.min("earliest").alias("earliest"))
        best = covered.join(classes, "other").groupBy("cls").agg(F.min(F.struct((-F.col("coverage")).alias("c"), F.col("earliest").alias("e"))).alias("b"))
        return skewed_join(materialize(members, "members"), best, ["cls"], ["record"]).select("record", F.col("b.e").alias("earlier"), (-F.col("b.c")).alias("coverage"))

    def update(self, texts: DataFrame, batch: int) -> None:
        """Take the batch in: postings of classes that are new, and records smaller than any before."""
        if batch in self.manifest()["batches"]:
            return
        members, each = _classed(texts.where(F.col("batch") == batch))
        mine = materialize(members.groupBy(F.col("cls").alias("other")).agg(F.min("record").alias("earliest")), "mine")
        known = materialize(self.store("classes", None, self.CLASSES).join(mine.select("other"), "other", "left_semi").groupBy("other").agg(F.min("earliest").alias("first")), "known")
        marked = materialize(self._marked(each.join(known.select(F.col("other").alias("cls")), "cls", "left_anti")), "new")
        smaller = mine.join(known, "other", "left").where("first is null or earliest < first").select("other", "earliest")
        self._take_in(batch, {"store": marked.select("kind", "size", "print", F.col("cls").alias("other"), "part"), "classes": smaller}, marked)
