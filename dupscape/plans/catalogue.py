"""The query catalogue over the test tables, with the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dupscape.functions.bits import grid_hash
from dupscape.functions.text import name_key, strip_markup, text_state
from dupscape.operators import content, exact, images, inventory, library, names, report, review, state
from dupscape.operators.graph import connected_components
from dupscape.operators.incremental import STAMP, IncrementalScan, land, versions
from dupscape.operators.inventory import ScanOptions
from dupscape.operators.skew import skewed_join
from dupscape.paths import ancestors, name, parent
from dupscape.session import materialize, scratch
from dupscape.sources.books import drm_status

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where SQL can state it."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    WITH seen AS (
        SELECT *, row_number() OVER (PARTITION BY session_no, file_path ORDER BY observed_at DESC NULLS LAST, ingested_at DESC NULLS LAST) AS n
        FROM file_stamps WHERE session_no IN (SELECT session_no FROM scan_sessions WHERE status = 'completed') AND file_path IS NOT NULL
    ), steps AS (
        SELECT session_no, file_path, row(device, inode, file_size, modified_s, modified_ns, changed_s, changed_ns) AS version,
            lag(row(device, inode, file_size, modified_s, modified_ns, changed_s, changed_ns)) OVER w AS last, row_number() OVER w AS k
        FROM seen WHERE n = 1 WINDOW w AS (PARTITION BY file_path ORDER BY session_no)
    )
    SELECT session_no, file_path FROM steps WHERE k = 1 OR version IS DISTINCT FROM last
""")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per completed session the files that are new or whose stamp has changed: what a first run gives out."""
    scan = IncrementalScan(spark, scratch(spark, "incremental"))
    return scan.run(_table(spark, sf_dir, "file_stamps"), _table(spark, sf_dir, "scan_sessions")).select("session_no", "file_path")


@query(ORACLES["p3_found"])
def p3_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one run after each completed session over what there was by then, state carried from run to run."""
    stamps, sessions = land(_table(spark, sf_dir, "file_stamps"), scratch(spark, "inbox")), _table(spark, sf_dir, "scan_sessions")
    scan = IncrementalScan(spark, scratch(spark, "incremental"))
    for r in sessions.where("status = 'completed'").select("session_no").distinct().orderBy("session_no").collect():
        scan.run(stamps.where(F.col("session_no") <= r.session_no), sessions.where(F.col("session_no") <= r.session_no))
    return scan.processed().select("session_no", "file_path")


# --- views of the test tables ---------------------------------------------------------------------------------------

BLOCK = 4
FILES_SQL = """files AS (
    SELECT '/lib/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc-' || doc_id || '.txt' AS path,
        octet_length(encode(text)) AS size, encode(text) AS content, sha256(text) AS full_hash, text, doc_id, source FROM documents WHERE text IS NOT NULL
)"""
GROUPED_SQL = "dup AS (SELECT full_hash FROM files WHERE size > 0 GROUP BY full_hash HAVING count(*) > 1)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the path from their columns, the text's bytes as content."""
    d = _table(spark, sf_dir, "documents").where("text is not null")
    part = lambda c: F.coalesce(c, F.lit("none"))
    path = F.concat(F.lit("/lib/"), part("source"), F.lit("/"), part("lang"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(path.alias("path"), F.octet_length("text").cast("bigint").alias("size"), F.encode("text", "UTF-8").alias("content"), "doc_id", "source")


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).withColumn("full_hash", exact.content_hash(F.col("content"))).drop("content")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.hashed_candidates(_files(spark, sf_dir).where("size > 0"), block=BLOCK)


# --- exact duplicates -----------------------------------------------------------------------------------------------


@query(f"WITH {FILES_SQL} SELECT full_hash, min(size) AS size, count(*) AS file_count, (count(*) - 1) * min(size) AS reclaimable_bytes FROM files WHERE size > 0 GROUP BY full_hash HAVING count(*) > 1")
def q01_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(_hashed(spark, sf_dir).where("size > 0"))


@query(f"WITH {FILES_SQL} SELECT path, size FROM files WHERE size IN (SELECT size FROM files GROUP BY size HAVING count(*) > 1)")
def q02_size_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.size_candidates(_files(spark, sf_dir).select("path", "size"))


SAMPLE_SQL = f"CASE WHEN size > {3 * BLOCK} THEN sha256(content[1:{BLOCK}] || content[size // 2 + 1:size // 2 + {BLOCK}] || content[size - {BLOCK} + 1:size]) ELSE full_hash END"


@query(f"WITH {FILES_SQL}, s AS (SELECT path, size, {SAMPLE_SQL} AS sample FROM files) SELECT path, size, sample FROM s WHERE (size, sample) IN (SELECT (size, sample) FROM s GROUP BY size, sample HAVING count(*) > 1)")
def q03_sample_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.sample_candidates(_files(spark, sf_dir), block=BLOCK).select("path", "size", "sample")


@query(ORACLES["q01_exact_groups"])
def q04_staged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(_members(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {GROUPED_SQL} SELECT path, size, full_hash FROM files WHERE full_hash IN (FROM dup)")
def q05_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("path", "size", "full_hash")


@query(f"WITH {FILES_SQL}, g AS (SELECT count(*) AS n, min(size) AS size FROM files WHERE size > 0 GROUP BY full_hash HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(n), 0) AS duplicate_files, coalesce(sum((n - 1) * size), 0) AS reclaimable_bytes FROM g")
def q06_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.summary(_members(spark, sf_dir))


@query(f"""WITH {FILES_SQL}, g AS (SELECT full_hash, count(*) AS file_count, (count(*) - 1) * min(size) AS reclaimable_bytes FROM files WHERE size > 0 GROUP BY full_hash HAVING count(*) > 1)
    SELECT *, row_number() OVER (ORDER BY reclaimable_bytes DESC, full_hash) AS position FROM g""")
def q06b_ranked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.ranked_groups(exact.duplicate_groups(_members(spark, sf_dir)).drop("size"))


# --- inventory ------------------------------------------------------------------------------------------------------

OPTIONS = ScanOptions(minimum_size=200, maximum_size=2000, extensions=("epub", "pdf"), excluded_paths=("/Volumes/Shelf/A", "/Volumes/Shelf//ref/"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "ebook_files").select(F.col("file_path").alias("path"), F.col("file_size").alias("size"), "modified_at", "is_network", "drm_status")


@query("""SELECT file_path AS path, file_size AS size FROM ebook_files WHERE file_size BETWEEN 100000 AND 5000000 AND lower(regexp_extract(file_path, '\\.([^./]*)$', 1)) IN ('epub', 'pdf')
    AND NOT (file_path = '/Volumes/Shelf/A' OR starts_with(file_path, '/Volumes/Shelf/A/') OR starts_with(file_path, '/Volumes/Shelf/ref/'))""")
def q07_inventory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory_filter(_inventory(spark, sf_dir), replace(OPTIONS, minimum_size=100_000, maximum_size=5_000_000)).select("path", "size")


@query("""SELECT DISTINCT file_path AS path FROM ebook_files WHERE NOT regexp_matches(file_path, '/\\.[^/]') AND (regexp_replace(file_path, '/[^/]*$', '') = '/Volumes/Attic/inbox' OR starts_with(file_path, '/Volumes/NAS-books/'))""")
def q08_below_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ScanOptions(non_recursive_paths=("/Volumes/Attic/inbox",))
    return inventory.below_roots(_inventory(spark, sf_dir), ["/Volumes/Attic/inbox", "/Volumes/NAS-books"], options).select("path")


@query("""WITH f AS (SELECT DISTINCT session_no, file_path AS path, device, inode FROM file_stamps WHERE file_path IS NOT NULL)
    SELECT session_no, min(path) AS path, device, inode, count(*) AS aliases FROM f WHERE device IS NOT NULL AND inode IS NOT NULL GROUP BY session_no, device, inode
    UNION ALL SELECT session_no, path, device, inode, 1 FROM f WHERE device IS NULL OR inode IS NULL""")
def q09_identity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identities of every session."""
    rows = _table(spark, sf_dir, "file_stamps").where("file_path is not null").select("session_no", F.col("file_path").alias("path"), "device", "inode").distinct()
    return inventory.one_per_identity(rows, each=["session_no"])


@query("""WITH s AS (SELECT DISTINCT session_no, regexp_replace(file_path, '/[^/]*$', '') AS folder FROM file_stamps WHERE session_no IN (SELECT session_no FROM scan_sessions WHERE status = 'completed'))
    SELECT session_no, file_path AS path FROM ebook_files JOIN s ON folder = regexp_replace(file_path, '/[^/]*$', '')
    WHERE NOT starts_with(file_path, '/Volumes/Shelf/A/') AND NOT starts_with(file_path, '/Volumes/Attic/')""")
def q09b_complete_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scopes of every completed session; the others did not read their folders to the end."""
    completed = _table(spark, sf_dir, "scan_sessions").where("status = 'completed'").select("session_no")
    done = _table(spark, sf_dir, "file_stamps").join(completed, "session_no", "left_semi").select("session_no", parent("file_path").alias("path"))
    blocked = spark.createDataFrame([("/Volumes/Shelf/A",), ("/Volumes/Attic",)], "path string")
    return inventory.complete_scopes(_inventory(spark, sf_dir), done, blocked, ["session_no"]).select("session_no", "path")


# --- one library against another ------------------------------------------------------------------------------------

IN_A = "regexp_matches(path, '^/lib/shelf-main/')"


@query(f"WITH {FILES_SQL}, r AS (SELECT path, size, full_hash, {IN_A} AS in_reference FROM files WHERE size > 0) SELECT * FROM r WHERE full_hash IN (SELECT full_hash FROM r GROUP BY full_hash HAVING bool_or(in_reference) AND bool_or(NOT in_reference))")
def q10_cross_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.cross_groups(_hashed(spark, sf_dir).where("size > 0"), ["/lib/shelf-main/"]).select("path", "size", "full_hash", "in_reference")


@query(f"WITH {FILES_SQL} SELECT path, size, full_hash FROM files WHERE NOT {IN_A} AND (size, full_hash) NOT IN (SELECT (size, full_hash) FROM files WHERE {IN_A})")
def q11_unique_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.unique_targets(_hashed(spark, sf_dir), ["/lib/shelf-main"]).select("path", "size", "full_hash")


@query(f"WITH {FILES_SQL} SELECT 'all read' AS case, path, size FROM files WHERE NOT {IN_A} AND (size, full_hash) NOT IN (SELECT (size, full_hash) FROM files WHERE {IN_A})")
def q12_unique_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cases: all files read; a reference file without a hash; an incomplete scan. Only the first may claim anything."""
    rows = _hashed(spark, sf_dir).select("path", "size", "full_hash")
    unread = spark.createDataFrame([("/lib/shelf-main/none/unread.txt", 5, None)], "path string, size bigint, full_hash string")
    cases = {"all read": (rows, False), "one unread": (rows.unionByName(unread), False), "incomplete": (rows, True)}
    out = None
    for case, (files, incomplete) in cases.items():
        found = library.unique_targets(files, ["/lib/shelf-main"], incomplete).select(F.lit(case).alias("case"), "path", "size")
        out = found if out is None else out.unionByName(found)
    return out


# --- file names -----------------------------------------------------------------------------------------------------

KEY_SQL = """regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')),
    '(\\s*[-_ ]?(copy|副本|重复|备份|\\(\\d+\\)|（\\d+）))+$', '', 'i'), '[\\s\\p{Z}\\p{P}]+', '', 'g')"""
GRAMS_SQL = """names AS (SELECT file_path AS path, file_size AS size, {key} AS key FROM ebook_files WHERE file_path IS NOT NULL),
    g AS (SELECT DISTINCT path, key, size, CASE WHEN length(key) < 3 THEN key ELSE substring(key, i, 3) END AS gram
          FROM names, LATERAL (SELECT unnest(range(1, greatest(length(key) - 1, 2))) AS i) WHERE key <> ''),
    n AS (SELECT path, count(*) AS n FROM g GROUP BY path)""".replace("{key}", KEY_SQL)
PAIRS_SQL = f"""{GRAMS_SQL}, c AS (
        SELECT a.path AS first_path, b.path AS second_path, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.path < b.path GROUP BY 1, 2
    ), pairs AS (
        SELECT first_path || '|' || second_path AS match_id, first_path, second_path, sa, sb, shared / (x.n + y.n - shared) AS score FROM c JOIN n x ON x.path = first_path JOIN n y ON y.path = second_path
    )"""


@query(f"SELECT file_path AS path, {KEY_SQL} AS key FROM ebook_files")
def q13_name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).select("path", name_key(name("path")).alias("key"))


@query(f"WITH {PAIRS_SQL} SELECT match_id, first_path, second_path, round(score, 9) AS score FROM pairs WHERE score >= 0.55")
def q14_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_matches(_inventory(spark, sf_dir), 0.55).withColumn("score", F.round("score", 9))


@query(f"""WITH {GRAMS_SQL}, k AS (SELECT DISTINCT key, gram FROM g), kn AS (SELECT key, count(*) AS n FROM k GROUP BY key),
    kc AS (SELECT a.key AS x, b.key AS y, count(*) AS c FROM k a JOIN k b ON a.gram = b.gram AND a.key <> b.key GROUP BY 1, 2),
    links AS (SELECT x AS key, count(*) AS links FROM kc JOIN kn p ON p.key = x JOIN kn q ON q.key = y WHERE c / (p.n + q.n - c) >= 0.55 GROUP BY x)
    SELECT path, key AS class_id, coalesce(links, 0) AS links FROM names LEFT JOIN links USING (key) WHERE key <> ''""")
def q14c_name_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in one row a file: its key, and the number of other keys that are similar."""
    members, links = names.name_classes(_inventory(spark, sf_dir), 0.55)
    ends = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    return skewed_join(members, ends, ["key"], ["path"], "left").select("path", F.col("key").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


@query(f"""WITH {PAIRS_SQL} SELECT match_id, round(score, 9) AS score FROM pairs WHERE score >= 0.85 AND sa IS NOT NULL AND sb IS NOT NULL
    AND CASE WHEN greatest(sa, sb) = 0 THEN 1 ELSE least(sa, sb) / greatest(sa, sb) END >= 0.6""")
def q15_name_pairs_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_matches(_inventory(spark, sf_dir), 0.85).select("match_id", F.round("score", 9).alias("score"))


MATCHED_SQL = "m AS (SELECT first_path AS a, second_path AS b, score FROM filename_matches WHERE first_path <> second_path)"
COMPONENTS_SQL = f"""{MATCHED_SQL}, e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
    reach(member, other) AS (SELECT a, a FROM e UNION SELECT r.member, e.b FROM reach r JOIN e ON e.a = r.other),
    comp AS (SELECT member, min(other) AS component FROM reach GROUP BY member)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of two different files; a score says nothing about being linked."""
    return _table(spark, sf_dir, "filename_matches").where("first_path <> second_path").select("first_path", "second_path", "score")


@query(f"WITH RECURSIVE {COMPONENTS_SQL} SELECT member, component FROM comp")
def q16_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_matches(spark, sf_dir), "first_path", "second_path")


GROUPS_SQL = f"""{COMPONENTS_SQL}, s AS (
        SELECT component, count(*) AS file_count, max(file_size) AS largest, CASE WHEN count(file_size) = count(*) THEN sum(file_size) - max(file_size) END AS duplicate_bytes
        FROM comp LEFT JOIN ebook_files ON file_path = member GROUP BY component
    ), b AS (SELECT component, max(score) AS highest_score FROM m JOIN comp ON member = a GROUP BY component),
    groups AS (SELECT component AS group_id, file_count, highest_score, largest, duplicate_bytes FROM s JOIN b USING (component))"""


@query(f"WITH RECURSIVE {GROUPS_SQL} SELECT * FROM groups")
def q17_match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.match_groups(_matches(spark, sf_dir), _inventory(spark, sf_dir))


@query(f"WITH RECURSIVE {GROUPS_SQL} SELECT * FROM (SELECT group_id, row_number() OVER (ORDER BY coalesce(largest, -1) DESC, highest_score DESC, group_id) AS position FROM groups) WHERE position <= 300")
def q17b_group_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of groups; 300 is the page's length."""
    return names.ranked_groups(names.match_groups(_matches(spark, sf_dir), _inventory(spark, sf_dir)), 300).select("group_id", "position")


# --- contents -------------------------------------------------------------------------------------------------------

STRIP_SQL = "regexp_replace(regexp_replace({0}, '<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'gis'), '<[^>]+>', chr(10), 'gs')"
for _entity, _char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
    STRIP_SQL = f"replace({STRIP_SQL}, '{_entity}', '{_char}')"
NORMAL_SQL = "regexp_replace(regexp_replace(regexp_replace({0}, '^[ \\t]*\\d{{1,5}}[ \\t]*$', ' ', 'gm'), '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"
SYMBOLS_SQL = "regexp_replace(lower({0}), '[\\s\\p{{Z}}\\p{{P}}]+', '', 'g')"


@query(f"SELECT doc_id, md5({STRIP_SQL.format('text')}) AS digest FROM documents")
def q18_strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(strip_markup(F.col("text"))).alias("digest"))


@query("SELECT book_id, CASE WHEN text IS NULL THEN 'failed' WHEN length(text) >= 200 THEN 'ready' ELSE 'tooShort' END AS state, length(text) AS chars FROM ebook_documents")
def q19_text_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "ebook_documents").select("book_id", text_state(F.col("text")).alias("state"), F.length("text").alias("chars"))


WINNOW_SQL = f"""syms AS (SELECT {{key}} AS id, {SYMBOLS_SQL.format('text')} AS s FROM {{table}} WHERE text IS NOT NULL {{where}}),
    chars AS (SELECT id, length(s) AS len, string_split(s, '') AS cs FROM syms WHERE length(s) >= 18),
    codes AS (SELECT id, len, generate_subscripts(cs, 1) AS i, unicode(unnest(cs)) + 1 AS c FROM chars),
    hashes AS (SELECT id, len, i, (""" + " + ".join(f"c{k}::HUGEINT * {pow(1_099_511_628_211, 17 - k, 1 << 64)}::HUGEINT % 18446744073709551616::HUGEINT" for k in range(18)) + """) % 18446744073709551616::HUGEINT AS h
        FROM (SELECT id, len, i, """ + ", ".join(f"lead(c, {k}) OVER w AS c{k}" if k else "c AS c0" for k in range(18)) + """ FROM codes WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE i <= len - 17),
    minima AS (SELECT id, len, i, min(h) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS m, h FROM hashes),
    prints AS (SELECT DISTINCT id, CASE WHEN len - 17 < 48 THEN h ELSE m END AS print FROM minima WHERE i >= 48 OR (len - 17 < 48 AND i = len - 17))"""


def _winnow_sql(key: str, table: str, where: str = "") -> str:
    return WINNOW_SQL.replace("{key}", key).replace("{table}", table).replace("{where}", where)


def _print_sums(prints: DataFrame) -> DataFrame:
    unsigned = lambda x: F.when(x < 0, x.cast("decimal(38,0)") + F.lit("18446744073709551616").cast("decimal(38,0)")).otherwise(x.cast("decimal(38,0)"))
    total = F.aggregate("prints", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + unsigned(x)).cast("decimal(38,0)"))
    return prints.where(F.size("prints") > 0).select("book_id", F.size("prints").cast("bigint").alias("n"), total.cast("string").alias("total"))


@query(f"WITH {_winnow_sql('book_id', 'ebook_documents')} SELECT id AS book_id, count(*) AS n, sum(print)::VARCHAR AS total FROM prints GROUP BY id")
def q20_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each book's raw text, as the SQL states them: their number and sum as unsigned values."""
    return _print_sums(content.fingerprints(_table(spark, sf_dir, "ebook_documents"), "book_id", "text", normalize=False))


@query()
def q20n_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the normalised texts; DuckDB has no NFKC, so no SQL states q20n to q24n."""
    return _print_sums(content.fingerprints(_table(spark, sf_dir, "ebook_documents"), "book_id", "text"))


READY = "state = 'ready'"
MATCH_SQL = f"""{_winnow_sql('book_id', 'ebook_documents', "AND state = 'ready'")},
    k AS (SELECT id, count(*) AS n FROM prints GROUP BY id),
    c AS (SELECT a.id AS first, b.id AS second, count(*) AS shared FROM prints a JOIN prints b ON a.print = b.print AND a.id < b.id GROUP BY 1, 2),
    v AS (SELECT first, second, shared / x.n AS first_coverage, shared / y.n AS second_coverage FROM c JOIN k x ON x.id = first JOIN k y ON y.id = second),
    w AS (SELECT *, 0.72 * (2 * first_coverage * second_coverage / greatest(0.0001, first_coverage + second_coverage)) + 0.28 * greatest(first_coverage, second_coverage) AS similarity FROM v)"""


def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "ebook_documents").where(READY)


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(c, 9) for c in ("similarity", "first_coverage", "second_coverage")})


def _levels(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("similarity") >= 0.72).alias("strict"), F.count_if(F.col("similarity") >= 0.48).alias("standard"), F.count(F.lit(1)).alias("loose"))


def _evidence(spark: SparkSession, sf_dir: str, normalize: bool) -> DataFrame:
    books = _ready(spark, sf_dir)
    matches = content.content_matches(books, "book_id", "text", normalize=normalize)
    found = content.with_evidence(matches, books, "book_id", "text", r"\.", normalize)
    return found.select(F.concat_ws("|", F.col("first").cast("string"), F.col("second").cast("string")).alias("match_id"), F.array_join("evidence", " ~ ").alias("evidence"))


@query(f"""WITH {MATCH_SQL} SELECT first, second, round(similarity, 9) AS similarity, round(first_coverage, 9) AS first_coverage, round(second_coverage, 9) AS second_coverage,
    CASE WHEN similarity >= 0.82 AND least(first_coverage, second_coverage) >= 0.72 THEN 'high' WHEN similarity >= 0.58 THEN 'much' ELSE 'partial' END AS classification FROM w WHERE similarity >= 0.48""")
def q21_content_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the raw texts, as the SQL states them."""
    return _rounded(content.content_matches(_ready(spark, sf_dir), "book_id", "text", normalize=False))


@query()
def q21n_content_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the normalised texts."""
    return _rounded(content.content_matches(_ready(spark, sf_dir), "book_id", "text"))


@query(f"""WITH {MATCH_SQL}, sets AS (SELECT id, string_agg(print::VARCHAR, ',' ORDER BY print) AS fp FROM prints GROUP BY id),
    ends AS (SELECT first AS id, b.fp FROM w JOIN sets b ON b.id = second WHERE similarity >= 0.48 UNION SELECT second, a.fp FROM w JOIN sets a ON a.id = first WHERE similarity >= 0.48)
    SELECT id AS book_id, min(id) OVER (PARTITION BY fp) AS class_id, (SELECT count(DISTINCT e.fp) FROM ends e WHERE e.id = s.id AND e.fp <> s.fp) AS links FROM sets s""")
def q21c_content_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in one row a book: the smallest book with an equal set of fingerprints, and the number of other sets that match."""
    members, links = content.content_classes(_ready(spark, sf_dir), "book_id", "text", normalize=False)
    ends = links.select(F.explode(F.array("ca", "cb")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("cls").agg(F.min("id").alias("class_id")).join(ends, "cls", "left")
    return skewed_join(members, classes, ["cls"], ["id"]).select(F.col("id").alias("book_id"), "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


@query(f"WITH {MATCH_SQL} SELECT count_if(similarity >= 0.72) AS strict, count_if(similarity >= 0.48) AS standard, count(*) AS loose FROM w WHERE similarity >= 0.28")
def q22_content_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the raw texts by level, as the SQL states them."""
    return _levels(content.content_matches(_ready(spark, sf_dir), "book_id", "text", "loose", normalize=False))


@query()
def q22n_content_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the normalised texts by level."""
    return _levels(content.content_matches(_ready(spark, sf_dir), "book_id", "text", "loose"))


@query(f"""WITH {MATCH_SQL}, t AS (SELECT first, second, a.text AS x, lower(b.text) AS y FROM w JOIN ebook_documents a ON a.book_id = first JOIN ebook_documents b ON b.book_id = second WHERE similarity >= 0.48)
    SELECT first || '|' || second AS match_id, array_to_string(list_slice(list_distinct_in_order, 1, 3), ' ~ ') AS evidence FROM (
        SELECT first, second, list_filter(found, lambda p, i: list_position(found, p) = i) AS list_distinct_in_order FROM (
            SELECT first, second, list_filter(list_transform(list_filter(string_split(x, '.'), lambda p: length(p) >= 24), lambda p: trim(substring(p, 1, 100), ' ')), lambda p: p <> '' AND contains(y, lower(p))) AS found FROM t))""")
def q23_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in the raw texts, as the SQL states it."""
    return _evidence(spark, sf_dir, normalize=False)


@query()
def q23n_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in the normalised texts."""
    return _evidence(spark, sf_dir, normalize=True)


_EXT = "'(.)\\.[^.]*$', '\\1'"
PREFILTER_SQL = f"""books AS (SELECT book_id AS id, lower(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(title, regexp_extract(file_path, '([^/]*)$', 1)), '/', ' ') || '.x', {_EXT}), {_EXT}),
        '(\\s*[-_ ]?(copy|副本|重复|备份|\\(\\d+\\)|（\\d+）))+$', '', 'i')) AS low FROM ebook_documents WHERE state = 'ready'),
    keys AS (SELECT id, regexp_replace(low, '[\\s\\p{{Z}}\\p{{P}}]+', '', 'g') AS key FROM books),
    gr AS (SELECT DISTINCT id, key, CASE WHEN length(key) < 3 THEN key ELSE substring(key, i, 3) END AS gram FROM keys, LATERAL (SELECT unnest(range(1, greatest(length(key) - 1, 2))) AS i) WHERE key <> ''),
    gn AS (SELECT id, count(*) AS n FROM gr GROUP BY id), gp AS (SELECT a.id AS x, b.id AS y, any_value(a.key) = any_value(b.key) AS same, count(*) AS c FROM gr a JOIN gr b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2),
    candidates AS (SELECT x, y FROM gp JOIN gn p ON p.id = x JOIN gn q ON q.id = y WHERE same OR c / (p.n + q.n - c) >= 0.42)"""


def _prefiltered(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    books = _ready(spark, sf_dir).withColumn("name", F.coalesce("title", name("file_path")))
    files = books.select(F.concat(F.lit("/"), F.col("book_id").cast("string"), F.lit("/"), F.replace("name", F.lit("/"), F.lit(" ")), F.lit(".x")).alias("path"), F.col("file_size").alias("size"))
    pairs = names.candidate_names(files, content.NAME_LEVELS["standard"], compose=whole)
    number = lambda c: F.split(c, "/")[1].cast("bigint")
    ids = pairs.select(F.least(number("first_path"), number("second_path")).alias("first"), F.greatest(number("first_path"), number("second_path")).alias("second"))
    return content.content_matches(books, "book_id", "text", candidates=ids, normalize=whole).withColumn("similarity", F.round("similarity", 9)).select("first", "second", "similarity")


@query(f"WITH {MATCH_SQL}, {PREFILTER_SQL} SELECT first, second, round(similarity, 9) AS similarity FROM w JOIN candidates ON x = first AND y = second WHERE similarity >= 0.48")
def q24_content_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content matches of raw texts among books whose raw names make them candidates, as the SQL states them."""
    return _prefiltered(spark, sf_dir, whole=False)


@query()
def q24n_content_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content matches of normalised texts among books whose composed names make them candidates."""
    return _prefiltered(spark, sf_dir, whole=True)


# --- folders --------------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, sf_dir: str, path, value) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(value.alias("v"))
    files = materialize(rows.select(path.alias("path"), F.lit(1).cast("bigint").alias("size"), F.sha2(F.col("v").cast("string"), 256).alias("full_hash")), "tree")
    return files, files.select(F.explode(ancestors("path")).alias("path")).where("path <> '/'").distinct()


@query("""WITH f AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
    d AS (SELECT o, string_agg(n || ':' || v, ',' ORDER BY n) AS digest, count(*) AS file_count FROM f GROUP BY o)
    SELECT '/o' || o AS folder, file_count, count(*) OVER (PARTITION BY digest) AS copies FROM d QUALIFY copies > 1""")
def q25_folder_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/o"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    files, folders = _tree(spark, sf_dir, path, F.min("l_quantity"))
    found = materialize(library.duplicate_folders(files, folders), "folders")
    return found.join(found.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "digest").select("folder", "file_count", "copies")


@query("""WITH f AS (SELECT l_orderkey // 2 AS p, l_orderkey % 2 AS c, l_linenumber AS n, min(l_returnflag) AS v FROM lineitem GROUP BY 1, 2, 3),
    d AS (SELECT p, c, string_agg(n || ':' || v, ',' ORDER BY n) AS digest, count(*) AS k FROM f GROUP BY p, c),
    t AS (SELECT p, string_agg(c || '{' || digest || '}', ';' ORDER BY c) AS tree, sum(k) AS file_count FROM d GROUP BY p)
    SELECT '/p' || p AS folder, file_count FROM t WHERE tree IN (SELECT tree FROM t GROUP BY tree HAVING count(*) > 1)""")
def q26_folder_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents whose whole trees are equal; the oracle compares the trees' spelled-out contents."""
    path = F.concat(F.lit("/p"), F.floor(F.col("l_orderkey") / 2).cast("string"), F.lit("/c"), (F.col("l_orderkey") % 2).cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    files, folders = _tree(spark, sf_dir, path, F.min("l_returnflag"))
    digests = library.folder_digests(files, folders).where("folder rlike '^/p[0-9]+$' and digest is not null")
    return exact.repeated(digests, ["digest"]).select("folder", "file_count")


@query(f"WITH {FILES_SQL}, a AS (SELECT size, unnest(['/', '/lib', '/lib/' || string_split(path, '/')[3], '/lib/' || string_split(path, '/')[3] || '/' || string_split(path, '/')[4]]) AS folder FROM files) SELECT folder, sum(size) AS total_bytes, count(*) AS file_count FROM a GROUP BY folder")
def q34_ancestor_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.ancestor_sums(_files(spark, sf_dir))


# --- images ---------------------------------------------------------------------------------------------------------

GRID_SQL = "string_split(substring(text, 1, 72), '')"
_BITS = " | ".join(
    f"(CASE WHEN unicode(cs[{r * 9 + c + 1}]) > unicode(cs[{r * 9 + c + 2}]) THEN 1::UBIGINT ELSE 0::UBIGINT END << {63 - r * 8 - c})" for r in range(8) for c in range(8)
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 72 code points of a text stand for an image's brightness grid."""
    d = _table(spark, sf_dir, "documents").where("length(text) >= 72")
    return d.select("doc_id", F.transform(F.sequence(F.lit(1), F.lit(72)), lambda i: F.call_function("ascii", F.substring("text", i, F.lit(1)))).alias("cells"))


def _hamming(spark: SparkSession, sf_dir: str, threshold: int) -> DataFrame:
    hashes = _cells(spark, sf_dir).select(grid_hash(F.col("cells")).alias("hash"))
    return images.near_hashes(hashes, threshold).groupBy(F.col("distance").cast("bigint").alias("distance")).agg(F.count(F.lit(1)).alias("pairs"))


@query(f"""WITH h AS (SELECT DISTINCT {_BITS} AS h FROM (SELECT {GRID_SQL} AS cs FROM documents WHERE length(text) >= 72))
    SELECT bit_count(xor(a.h, b.h)) AS distance, count(*) AS pairs FROM h a JOIN h b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 4 GROUP BY 1""")
def q27_hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different hashes within four bits, by distance."""
    return _hamming(spark, sf_dir, 4)


@query(f"""WITH h AS (SELECT DISTINCT {_BITS} AS h FROM (SELECT {GRID_SQL} AS cs FROM documents WHERE length(text) >= 72))
    SELECT bit_count(xor(a.h, b.h)) AS distance, count(*) AS pairs FROM h a JOIN h b ON a.h < b.h WHERE bit_count(xor(a.h, b.h)) <= 8 GROUP BY 1""")
def q27d_hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within the default of eight bits."""
    return _hamming(spark, sf_dir, 8)


@query()
def q28_image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at the default threshold. Three hashes an image: of the grid, of its rows moved on by one, of it backwards."""
    d = _cells(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "cells")
    moved = F.concat(F.slice("cells", 10, 63), F.slice("cells", 1, 9))
    hashes = F.array(grid_hash(F.col("cells")), grid_hash(moved), grid_hash(F.reverse("cells")))
    light = F.transform("cells", lambda x: (x % 256).cast("double"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    d = d.select("path", hashes.alias("hashes"), light.alias("light")).withColumn("mean", total("light") / 72)
    deviation = F.sqrt(total(F.transform("light", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / 72)
    return images.similar_image_groups(d.select("path", "hashes", "mean", deviation.alias("deviation")))


# --- review, state and reports --------------------------------------------------------------------------------------

MEMBERS_SQL = f"{FILES_SQL}, {GROUPED_SQL}, members AS (SELECT path, size, full_hash FROM files WHERE full_hash IN (FROM dup))"


@query(f"""WITH {MEMBERS_SQL}, r AS (SELECT *, CASE WHEN starts_with(path, '/lib/shelf-main/') THEN 0 ELSE 2 END AS rank FROM members),
    o AS (SELECT *, row_number() OVER (PARTITION BY full_hash ORDER BY rank, length(path), path) AS n FROM r)
    SELECT path, full_hash, rank, CASE WHEN n = 1 THEN 'keep' WHEN rank = 0 THEN 'leave' ELSE 'remove' END AS action FROM o""")
def q29_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.suggested_keepers(_members(spark, sf_dir), "full_hash", protected=["/lib/shelf-main"]).select("path", "full_hash", "rank", "action")


@query(f"""WITH {MEMBERS_SQL}, s AS (SELECT *, length(path) % 2 = 0 AS chosen FROM members)
    SELECT path, full_hash, chosen AND NOT (bool_and(chosen) OVER g AND path = min(path) OVER g) AS chosen FROM s WINDOW g AS (PARTITION BY full_hash)""")
def q30_selection_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _members(spark, sf_dir).withColumn("chosen", F.length("path") % 2 == 0)
    return review.repaired_selection(rows, "full_hash", "chosen").select("path", "full_hash", "chosen")


@query(f"WITH {MEMBERS_SQL} SELECT path, full_hash FROM members WHERE full_hash IN (SELECT full_hash FROM members WHERE contains(lower(path), '/zh'))")
def q31_search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.groups_matching(_members(spark, sf_dir), "full_hash", "/ZH").select("path", "full_hash")


_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in STAMP)


_STAMPS = ", ".join(STAMP)
STEPS_SQL = f"""done AS (SELECT DISTINCT session_no FROM scan_sessions WHERE status = 'completed'), steps AS (SELECT session_no, lead(session_no) OVER (ORDER BY session_no) AS following FROM done),
    b AS (SELECT DISTINCT ON (session_no, file_path) session_no, file_path, {_STAMPS} FROM file_stamps WHERE session_no IN (FROM done) AND file_path IS NOT NULL
        ORDER BY session_no, file_path, observed_at DESC NULLS LAST, ingested_at DESC NULLS LAST),
    a AS (SELECT following AS session_no, file_path, {_STAMPS} FROM b JOIN steps USING (session_no) WHERE following IS NOT NULL)"""


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files of the completed session before each completed one, under the later one's number, and the files of each; nothing is before the first."""
    done = _table(spark, sf_dir, "scan_sessions").where("status = 'completed'").select("session_no").distinct()
    seen = versions(_table(spark, sf_dir, "file_stamps").join(done, "session_no", "left_semi"))
    seen = materialize(seen.select("session_no", F.col("file_path").alias("path"), "version.*"), "seen")
    # sessions are few: one row a scan
    following = done.withColumn("following", F.lead("session_no").over(Window.orderBy("session_no"))).where("following is not null")
    old = seen.join(following, "session_no").drop("session_no").withColumnRenamed("following", "session_no")
    return old, seen


@query(f"""WITH {STEPS_SQL} SELECT coalesce(a.session_no, b.session_no) AS session_no, coalesce(a.file_path, b.file_path) AS path,
    CASE WHEN a.file_path IS NULL THEN 'added' WHEN b.file_path IS NULL THEN 'deleted' WHEN {_SAME} THEN 'unchanged' ELSE 'modified' END AS change
    FROM a FULL JOIN b ON a.file_path = b.file_path AND a.session_no = b.session_no""")
def q32_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each completed session against the completed one before it; all files of the first are added."""
    old, new = _steps(spark, sf_dir)
    return state.reconcile(old, new, ["session_no", "path"], STAMP)


@query(f"WITH {STEPS_SQL} SELECT b.session_no, b.file_path AS path, CASE WHEN {_SAME} AND a.file_path IS NOT NULL THEN sha256(a.file_path) END AS full_hash FROM b LEFT JOIN a ON a.file_path = b.file_path AND a.session_no = b.session_no")
def q33_hash_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes that each completed session can take from the completed one before it."""
    old, new = _steps(spark, sf_dir)
    cache = old.withColumn("full_hash", F.sha2("path", 256))
    return exact.reuse_hashes(new, cache, ["session_no", "path"], list(STAMP), ["full_hash"]).select("session_no", "path", "full_hash")


@query("""WITH o AS (SELECT DISTINCT unnest(roots) AS path FROM scan_sessions WHERE session_no <= 4), n AS (SELECT DISTINCT unnest(roots) AS path FROM scan_sessions WHERE session_no > 4)
    SELECT path FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = n.path OR starts_with(o.path, n.path || '/') OR starts_with(n.path, o.path || '/'))""")
def q35_root_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "scan_sessions").select("session_no", F.explode("roots").alias("path"))
    return inventory.disjoint_roots(s.where("session_no > 4").select("path").distinct(), s.where("session_no <= 4").select("path").distinct())


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id DESC) AS position FROM events QUALIFY position <= 30")
def q36_history_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30 runs; the bound is the feature."""
    return state.latest_runs(_table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "position")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).withColumn("modified_at", F.timestamp_seconds(F.col("doc_id") * 60)).withColumn("is_network", F.col("doc_id") % 2 == 0)


@query(f"""WITH {FILES_SQL}, {GROUPED_SQL} SELECT full_hash || ',"' || replace(path, '"', '""') || '",' || size || ',' || strftime(make_timestamp(doc_id * 60000000), '%Y-%m-%dT%H:%M:%SZ') || ',' || (doc_id % 2 = 0) AS line
    FROM files WHERE full_hash IN (FROM dup)""")
def q37_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.csv_lines(_report(spark, sf_dir))


@query(f"""WITH {MEMBERS_SQL} SELECT full_hash, count(*) AS files, min(path) AS first_path, (count(*) - 1) * min(size) AS reclaimable_bytes FROM members GROUP BY full_hash""")
def q37b_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report read back, the parts of a group put together."""
    kind = "files array<struct<path:string>>, full_hash string, reclaimable_bytes bigint"
    rows = report.json_rows(_report(spark, sf_dir)).select(F.from_json("json", kind).alias("j"))
    parts = rows.select("j.full_hash", F.size("j.files").cast("bigint").alias("files"), F.get("j.files", F.lit(0))["path"].alias("first_path"), "j.reclaimable_bytes")
    return parts.groupBy("full_hash").agg(F.sum("files").alias("files"), F.min("first_path").alias("first_path"), F.max("reclaimable_bytes").alias("reclaimable_bytes"))


@query("""SELECT file_id, CASE WHEN file_ext NOT IN ('mobi', 'azw', 'azw3') OR file_ext IS NULL THEN 'unknown' WHEN file_id % 3 = 0 THEN 'notDetected' ELSE 'suspected' END AS status FROM ebook_files""")
def q38_drm_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers made from ids: the first record's protection field is zero for every third file."""
    field = F.when(F.col("file_id") % 3 == 0, "0000").otherwise("0001")
    header = F.unhex(F.concat(F.lit("00" * 78 + "00000060" + "00" * 14), F.lit("00" * 12), field, F.lit("00" * 4)))
    return _table(spark, sf_dir, "ebook_files").select("file_id", drm_status(header, F.col("file_ext")).alias("status"))


@query("SELECT is_network, count(*) AS files, count_if(drm_status <> 'unknown') AS checked, count_if(drm_status = 'suspected') AS encrypted, count_if(drm_status = 'unknown') AS unknown FROM ebook_files GROUP BY is_network")
def q39_drm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda rule, c: F.count_if(F.expr(rule)).alias(c)
    return _inventory(spark, sf_dir).groupBy("is_network").agg(F.count(F.lit(1)).alias("files"), count("drm_status <> 'unknown'", "checked"), count("drm_status = 'suspected'", "encrypted"), count("drm_status = 'unknown'", "unknown"))


@query(f"""WITH {MEMBERS_SQL}, plan AS (SELECT path, full_hash FROM members WHERE length(path) % 2 = 0)
    SELECT path, full_hash, 'lastCopy' AS problem FROM plan p WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.full_hash = p.full_hash AND length(m.path) % 2 <> 0)
    UNION ALL SELECT path, full_hash, 'protected' FROM plan WHERE starts_with(path, '/lib/shelf-main/')""")
def q40_cleanup_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_members(spark, sf_dir).select("path", "full_hash"), "members")
    return review.cleanup_problems(rows.where("length(path) % 2 = 0"), rows, "full_hash", ["/lib/shelf-main"])
