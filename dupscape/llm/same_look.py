"""Records that look the same but are stored in different characters."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscape.llm.lookalikes import Folding, corpus_folding, slices
from dupscape.operators.skew import salted_pairs, skewed_join
from dupscape.session import materialize, spread


def folded(df: DataFrame, key: str, columns: list[str], folding: Folding | None = None) -> DataFrame:
    """``(key, <column>_form ...)``: each text in its one form; null stays null and empty stays empty.

    Only ``key`` and ``columns`` are read, so further columns, whatever their names, change nothing.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(folding or corpus_folding(df, columns))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        f = shared.value
        for batch in batches:
            forms = [pa.array([None if t is None else f.fold(t) for t in batch.column(c).to_pylist()], pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(key), *forms], names=[key, *(f"{c}_form" for c in columns)])

    return df.select(key, *columns).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c}_form string" for c in columns))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def form_keys(df: DataFrame, key: str, columns: list[str], folding: Folding) -> DataFrame:
    """``(key, field_name, form, raw)``: 128-bit digests of each value's one form and of the value as stored.

    A null or empty value, and one that consists of invisible characters only, has no row.
    """
    shared = df.sparkSession.sparkContext.broadcast(folding)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        f = shared.value
        for batch in batches:
            ids = batch.column(key).to_pylist()
            for name in columns:
                values = batch.column(name).to_pylist()
                for a, b in slices((len(v or "") for v in values), 1 << 21):
                    rows = [(i, form, v) for i, v in zip(ids[a:b], values[a:b]) if v and (form := f.fold(v))]
                    yield pa.RecordBatch.from_pydict(
                        {
                            key: pa.array([r[0] for r in rows], batch.schema.field(key).type),
                            "field_name": pa.array([name] * len(rows), pa.string()),
                            "form": pa.array([_digest(r[1]) for r in rows], pa.binary()),
                            "raw": pa.array([_digest(r[2]) for r in rows], pa.binary()),
                        }
                    )

    return spread(df, [key, *columns]).mapInArrow(run, f"{key} {kind}, field_name string, form binary, raw binary")


def look_alike_pairs(df: DataFrame, key: str, columns: list[str], folding: Folding | None = None, block: int = 256) -> DataFrame:
    """Pairs of records whose ``columns`` look the same but are stored differently: (first, second, field_name).

    Values are compared in the form of :mod:`dupscape.llm.lookalikes`, with representatives counted over all rows.
    Values stored alike are first put together, so only stored variants are paired, each pair of variants once, and
    then given their records; a pair of equal values is never made. A form of very many variants is paired in blocks of
    ``block`` variants, and the records of a value that very many keep are spread over tasks. Null, empty and wholly invisible values have no pairs; repeated keys are one
    record; an empty table gives no rows.
    """
    folding = folding or corpus_folding(df, columns)
    keys = materialize(form_keys(df, key, columns, folding).distinct(), "forms")
    variants = keys.groupBy("field_name", "form", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = variants.groupBy("field_name", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("field_name", "form")
    variants = materialize(variants.join(several, ["field_name", "form"], "left_semi").select("field_name", "form", "raw"), "variants")
    links = materialize(salted_pairs(variants, ["field_name", "form"], "raw", block=block).select("field_name", "form", "raw_a", "raw_b"), "variant-pairs")
    # only records of values that have variants go on
    held = materialize(keys.join(variants, ["field_name", "form", "raw"], "left_semi"), "held")
    left = held.select("field_name", "form", F.col("raw").alias("raw_a"), F.col(key).alias("key_a"))
    right = held.select("field_name", "form", F.col("raw").alias("raw_b"), F.col(key).alias("key_b"))
    one = skewed_join(left, links, ["field_name", "form", "raw_a"], ["key_a"])
    pairs = skewed_join(right, one, ["field_name", "form", "raw_b"], ["key_b"])
    return pairs.select(F.least("key_a", "key_b").alias("first"), F.greatest("key_a", "key_b").alias("second"), "field_name").where("first <> second").distinct()
