"""The subpackage's queries over the test tables; ``ORACLES`` holds the SQL of those that SQL can state."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscape.llm.components import linked_groups
from dupscape.llm.encoding import encode_corpus
from dupscape.llm.history import PER_WORD, FileHistory, file_fingerprints, known_records, overlapping_records, text_fingerprints
from dupscape.llm.leakage import leaked_items
from dupscape.llm.near_edits import near_duplicate_pairs
from dupscape.llm.residue import residue_documents
from dupscape.llm.same_look import look_alike_pairs
from dupscape.llm.survivors import MISSING, is_real, learned_precedence, survivors
from dupscape.paths import below, plain
from dupscape.plans.catalogue import _winnow_sql
from dupscape.session import materialize, scratch

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; DUPSCAPE_TOKENIZERS names another folder than the installed one."""
    return os.path.join(os.environ.get("DUPSCAPE_TOKENIZERS", "/opt/tokenizers"), name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each group with what decides between them: trust, known size, known date."""
    groups = _table(spark, sf_dir, "filename_groups").select("group_id", "session_no", F.explode(F.array_distinct("files")).alias("file_path"))
    sessions = _table(spark, sf_dir, "scan_sessions").select("session_no", F.transform("reference_paths", plain).alias("roots"), "started_at")
    files = _table(spark, sf_dir, "ebook_files").select("file_id", "file_path", "title", "author", "file_size", "modified_at")
    place = plain("file_path")
    return (
        groups.join(sessions, "session_no", "left")
        .join(files, "file_path")
        .select(
            "group_id",
            "file_id",
            "title",
            "author",
            F.coalesce(F.exists("roots", lambda r: below(place, r)), F.lit(False)).alias("trusted"),
            F.when(F.col("file_size") > 0, F.col("file_size")).alias("size"),
            F.when((F.col("modified_at") >= F.lit("1990-01-01 00:00:00").cast("timestamp")) & (F.col("started_at").isNull() | (F.col("modified_at") <= F.col("started_at"))), F.col("modified_at")).alias("dated"),
        )
    )


def _orders() -> tuple[list, dict]:
    trusted, size, dated = F.col("trusted").cast("int"), F.col("size"), F.unix_micros("dated")
    return [trusted, dated], {"path": [trusted, size, dated]}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group the file to keep and the files that supply title and author, by the stated order."""
    order, by_field = _orders()
    fields = {"path": None, "title": F.col("title"), "author": F.col("author")}
    return survivors(_members(spark, sf_dir), "group_id", "file_id", fields, order, field_order=by_field)


def p1_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and authors by currency alone: dates where known, learned precedence of styles where not."""
    members = materialize(_members(spark, sf_dir), "group-members")
    fields = {"title": F.col("title"), "author": F.col("author")}
    learned = {name: learned_precedence(members.where(is_real(value)), ["group_id"], name, "dated") for name, value in fields.items()}
    return survivors(members, "group_id", "file_id", fields, _orders()[0][:1], when="dated", learned=learned)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books in state ready whose compared texts' runs of eight characters have a Jaccard similarity of 0.6 or more."""
    ready = _table(spark, sf_dir, "ebook_documents").where("state = 'ready'")
    pairs = near_duplicate_pairs(ready, "book_id", "text", unit="chars", size=8, threshold=0.6, bands=56, rows=4)
    return pairs.select(F.col("first").alias("first_id"), F.col("second").alias("second_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each batch that an earlier batch holds, wholly or by their sample."""
    prints = file_fingerprints(_table(spark, sf_dir, "session_files"), "record_id", "session_no", "file_size", "sample_hash", "full_hash")
    found = known_records(materialize(prints, "prints"))
    return found.select(F.col("earlier").alias("earlier_id"), F.col("record").alias("record_id"), F.col("kind").alias("match_kind"))


def p4_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one batch after another against a history that is only probed, looked up and extended."""
    prints = materialize(file_fingerprints(_table(spark, sf_dir, "session_files"), "record_id", "session_no", "file_size", "sample_hash", "full_hash"), "prints")
    history, out = FileHistory(spark, scratch(spark, "history"), words=max(64, prints.count() // PER_WORD), parts=4), None
    for r in prints.select("batch").distinct().orderBy("batch").collect():  # one row a session
        found = history.accept(prints.where(F.col("batch") == r.batch), r.batch)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("earlier").alias("earlier_id"), F.col("record").alias("record_id"), F.col("kind").alias("match_kind"))


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of which one modified in an earlier month covers 0.8 or more of the winnowed fingerprints."""
    month = F.year("modified_at") * 12 + F.month("modified_at")
    books = _table(spark, sf_dir, "ebook_documents").withColumn("month", month)
    return overlapping_records(text_fingerprints(books, "book_id", "month", "text")).withColumn("coverage", F.round("coverage", 9))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose title or text looks the same but is stored differently."""
    pairs = look_alike_pairs(_table(spark, sf_dir, "ebook_documents"), "book_id", ["title", "text"])
    return pairs.select(F.col("first").alias("first_id"), F.col("second").alias("second_id"), "field_name")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every linked file with the smallest path of its group."""
    groups = linked_groups(_table(spark, sf_dir, "filename_matches"), "first_path", "second_path")
    return groups.select(F.col("member").alias("file_path"), F.col("group").alias("group_path"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which they hold a passage."""
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a stretch whose weighted shingles are 0.8 or more like those of a whole evaluation item."""
    return leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), similarity=0.8)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are template residue, filler, error pages or script notices in more than half of their characters."""
    return residue_documents(_table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_currency, p2_found, p4_found, p4_replay, p4_texts, p5_found, p6_found, p7_ids, p8_found, p8_similar, p9_found)}

_WORDS = ", ".join(f"'{w}'" for w in MISSING)
_REAL = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')) NOT IN ('', " + _WORDS.replace("{", "{{") + ")"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '/+', '/', 'g'), '/\\./', '/', 'g'), '/[^/]+/\\.\\.(/|$)', '/', 'g'), '(.)/$', '\\1')"
_HASH = "regexp_replace(lower(regexp_replace({0}, '\\s+', '', 'g')), '^sha256:', '')"
_USABLE = f"CASE WHEN regexp_full_match({_HASH}, '[0-9a-f]{{{{64}}}}') AND {_HASH} <> repeat(left({_HASH}, 1), 64) THEN {_HASH} END"

ORACLES: dict[str, str] = {
    "p1_found": f"""
        WITH roots AS (
            SELECT session_no, {_PLAIN.format("r")} AS root FROM (SELECT session_no, unnest(reference_paths) AS r FROM scan_sessions)
        ), members AS (
            SELECT DISTINCT g.group_id, f.file_id, f.title, f.author,
                EXISTS (SELECT 1 FROM roots r WHERE r.session_no = g.session_no AND starts_with(f.file_path, r.root || '/')) AS trusted,
                CASE WHEN f.file_size > 0 THEN f.file_size END AS size,
                CASE WHEN f.modified_at >= TIMESTAMP '1990-01-01' AND (s.started_at IS NULL OR f.modified_at <= s.started_at) THEN f.modified_at END AS dated
            FROM (SELECT group_id, session_no, unnest(files) AS file_path FROM filename_groups) g
            JOIN ebook_files f USING (file_path) LEFT JOIN scan_sessions s USING (session_no)
        ), ranked AS (
            SELECT group_id, 'path' AS field_name, file_id,
                row_number() OVER (PARTITION BY group_id ORDER BY trusted DESC, size DESC NULLS LAST, dated DESC NULLS LAST, file_id) AS n FROM members
            UNION ALL SELECT group_id, 'title', file_id, row_number() OVER (PARTITION BY group_id ORDER BY trusted DESC, dated DESC NULLS LAST, file_id)
            FROM members WHERE {_REAL.format("title")}
            UNION ALL SELECT group_id, 'author', file_id, row_number() OVER (PARTITION BY group_id ORDER BY trusted DESC, dated DESC NULLS LAST, file_id)
            FROM members WHERE {_REAL.format("author")}
        )
        SELECT group_id, field_name, file_id FROM ranked WHERE n = 1
    """,
    "p4_found": f"""
        WITH hashes AS (
            SELECT record_id, session_no, file_size, {_USABLE.format("sample_hash")} AS s, {_USABLE.format("full_hash")} AS f FROM session_files WHERE file_size > 0
        ), prints AS (
            SELECT record_id, session_no, 'exact' AS match_kind, file_size, coalesce(f, CASE WHEN file_size <= 196608 THEN s END) AS h FROM hashes
            UNION ALL SELECT record_id, session_no, 'near', file_size, s FROM hashes WHERE file_size > 196608
        ), hits AS (
            SELECT b.record_id, b.match_kind, min(a.record_id) AS earlier_id
            FROM prints a JOIN prints b USING (match_kind, file_size, h) WHERE a.session_no < b.session_no GROUP BY 1, 2
        )
        SELECT earlier_id, record_id, match_kind FROM hits
        WHERE match_kind = 'exact' OR record_id NOT IN (SELECT record_id FROM hits WHERE match_kind = 'exact')
    """,
    "p6_found": """
        WITH RECURSIVE pairs AS (
            SELECT first_path AS a, second_path AS b FROM filename_matches WHERE first_path <> second_path
            UNION SELECT second_path, first_path FROM filename_matches WHERE first_path <> second_path
        ), reach(file_path, other) AS (
            SELECT a, a FROM pairs
            UNION SELECT r.file_path, p.b FROM reach r JOIN pairs p ON p.a = r.other
        )
        SELECT file_path, min(other) AS group_path FROM reach GROUP BY file_path
    """,
}
ORACLES["p4_replay"] = ORACLES["p4_found"]
ORACLES["p4_texts"] = f"""
    WITH {_winnow_sql("book_id", "ebook_documents")}, months AS (SELECT book_id AS id, year(modified_at) * 12 + month(modified_at) AS month FROM ebook_documents WHERE modified_at IS NOT NULL),
    n AS (SELECT id, count(*) AS n FROM prints GROUP BY id),
    shared AS (SELECT b.id AS record, a.id AS earlier, count(*) AS k FROM prints a JOIN prints b ON a.print = b.print JOIN months x ON x.id = a.id JOIN months y ON y.id = b.id WHERE x.month < y.month GROUP BY 1, 2)
    SELECT record, earlier, round(k / n, 9) AS coverage FROM shared JOIN n ON n.id = record WHERE k / n >= 0.8
    QUALIFY row_number() OVER (PARTITION BY record ORDER BY k / n DESC, earlier) = 1
"""

_STYLE = (
    "concat(CASE WHEN regexp_matches({0}, '(copy|副本|备份|_final|- old|\\(\\d+\\)|（\\d+）)\\s*$', 'i') THEN 'c' ELSE '' END, CASE WHEN contains({0}, '_') THEN 'u' ELSE '' END, "
    "CASE WHEN regexp_matches({0}, '^[^,]+,\\s*[^,]+$') THEN 'i' ELSE '' END, CASE WHEN regexp_matches({0}, '^\\p{{Lu}}\\.') THEN 'n' ELSE '' END, "
    "CASE WHEN lower({0}) = {0} AND upper({0}) <> {0} THEN 'l' WHEN upper({0}) = {0} AND lower({0}) <> {0} THEN 'U' ELSE '' END)"
)
_VALUES = " UNION ALL ".join(f"SELECT group_id, file_id, trusted, dated, '{f}' AS field_name, {_STYLE.format(f)} AS style FROM members WHERE {_REAL.format(f)}" for f in ("title", "author"))
ORACLES["p1_currency"] = f"""
    WITH RECURSIVE {ORACLES["p1_found"].split("WITH ", 1)[1].split(", ranked AS", 1)[0].rstrip()}, v AS ({_VALUES}),
    spans AS (SELECT group_id, field_name, style, min(dated) AS since FROM v WHERE dated IS NOT NULL GROUP BY ALL),
    n AS (SELECT a.field_name, a.style AS a, b.style AS b, count(*) AS k FROM spans a JOIN spans b USING (group_id, field_name) WHERE a.style <> b.style AND a.since < b.since GROUP BY ALL),
    edges AS (SELECT n.field_name, n.a, n.b FROM n LEFT JOIN n r ON r.field_name = n.field_name AND r.a = n.b AND r.b = n.a WHERE n.k > coalesce(r.k, 0)),
    closed(field_name, a, b) AS (SELECT * FROM edges UNION SELECT c.field_name, c.a, e.b FROM closed c JOIN edges e ON e.field_name = c.field_name AND e.a = c.b),
    before AS (SELECT c.* FROM closed c WHERE NOT EXISTS (SELECT 1 FROM closed r WHERE r.field_name = c.field_name AND r.a = c.b AND r.b = c.a)),
    candidates AS (SELECT *, dated IS NOT NULL AS known FROM v QUALIFY dated IS NULL OR row_number() OVER (PARTITION BY group_id, field_name, dated IS NULL ORDER BY dated DESC, trusted DESC, file_id) = 1),
    latest AS (
        SELECT * FROM candidates x WHERE NOT EXISTS (
            SELECT 1 FROM candidates y JOIN before p ON p.field_name = y.field_name AND p.b = y.style WHERE y.group_id = x.group_id AND y.field_name = x.field_name AND p.a = x.style)
    )
    SELECT group_id, field_name, file_id FROM latest QUALIFY row_number() OVER (PARTITION BY group_id, field_name ORDER BY known DESC, trusted DESC, file_id) = 1
"""
