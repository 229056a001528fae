import io
import json
import os
import struct
import zipfile
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dupscape.operators import review, state
from dupscape.operators.incremental import STAMP, IncrementalScan, changed_rows
from dupscape.operators.inventory import ScanOptions
from dupscape.plans.engine import Engine
from dupscape.sources.books import drm_status, extract, palmdoc
from dupscape.streaming.duplicates import JobControl, content_stream, start_groups


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scan(spark, rows, tmp_path):
    root = tmp_path / "r"
    write(root / "one.txt", "same bytes")
    write(root / "two.txt", "same bytes")
    write(root / "sub/one.txt", "different")
    write(root / ".hidden", "same bytes")
    big = bytearray(os.urandom(400_000))
    write(root / "sub/big1", bytes(big))
    big[100_000] ^= 1
    write(root / "sub/big2", bytes(big))
    os.link(root / "one.txt", root / "link.txt")
    os.symlink(root, root / "loop")
    engine = Engine(spark, cache=str(tmp_path / "cache"))
    result = engine.scan([str(root), str(root)])
    assert result.files.count() == 6 and rows(result.groups, "file_count", "reclaimable_bytes") == [(2, 10)] and not result.incomplete
    write(root / "two.txt", "other byte")
    assert rows(engine.scan([str(root)]).groups) == []
    engine.clear_cache()
    assert engine.stored_hashes().count() == 0
    assert engine.scan([str(root)], ScanOptions(excluded_paths=(str(root / "sub"),), extensions=("txt",))).files.count() == 3
    assert engine.scan([str(root / "missing")]).incomplete


def test_reference_scan_and_sessions(spark, rows, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    write(a / "x", "shared")
    write(b / "y", "shared")
    write(b / "unique.bin", "only here")
    store = state.SessionStore(spark, str(tmp_path / "session"))
    options = ScanOptions(mode="reference", reference_paths=(str(a),))
    engine = Engine(spark)
    result = engine.scan([str(a), str(b)], options, store)
    assert [r.path for r in result.unique.collect()] == [str(b / "unique.bin")] and result.groups.count() == 1
    again = engine.scan([], ScanOptions(), store, resume=True)
    assert again.unique.count() == 1 and store.load()["status"] == state.COMPLETED
    found, failed = state.list_sessions(str(tmp_path))
    assert len(found) == 1 and failed == 0
    with pytest.raises(state.SessionError):
        store.with_roots(store.load(), [str(a / "sub")])
    with pytest.raises(state.SessionError):
        state.SessionStore(spark, str(a / "inside")).create([str(a)], ScanOptions())
    path = tmp_path / "session/manifest.json"
    path.write_text(json.dumps(json.loads(path.read_text()) | {"version": 999}))
    with pytest.raises(state.SessionError):
        store.load()


def epub(order):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<rootfile full-path="O/p.opf"/>')
        z.writestr("O/p.opf", '<item href="two.xhtml" id="b"/><item id="a" href="one%2Exhtml"/>' + "".join(f'<itemref idref="{i}"/>' for i in order))
        z.writestr("O/one.xhtml", "<p>" + "first " * 60 + "</p>")
        z.writestr("O/two.xhtml", "<p>" + "second " * 60 + "</p>")
    return out.getvalue()


def mobi(compression, body, texts=1, protection=0):
    head = b"\0" * 76 + struct.pack(">H", 2) + struct.pack(">I", 94) + b"\0" * 4 + struct.pack(">I", 110) + b"\0" * 4
    return head + struct.pack(">HHIHHHH", compression, 0, 0, texts, 0, 0, protection)[:12] + struct.pack(">HH", protection, 0) + body


def test_books(spark):
    assert extract(epub("ab"), "epub")[0].startswith("first") and extract(epub(""), "epub")[1] == "ready"
    text = ("plain words " * 30).encode()
    assert extract(mobi(1, text), "mobi")[1] == "ready" and extract(mobi(2, text), "azw3")[1] == "ready"
    assert extract(mobi(17480, text), "mobi")[1] == "unsupported" and extract(mobi(1, text, texts=0), "mobi")[1] == "failed" and extract(mobi(1, text, protection=1), "azw")[1] == "encrypted"
    assert palmdoc(b"abc\x80\x18") == b"abcabc" and palmdoc(b"\x02xy\xc1") == b"xy A"
    stream = zlib.compress(b"BT (" + b"Some text \\(here\\) " * 20 + b") Tj ET")
    assert extract(b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>> stream\n" + stream + b"\nendstream", "pdf")[1] == "ready"
    assert extract(b"%PDF-1.4", "pdf")[1] == "scannedPDF" and extract(b"no", "epub")[1] == "failed" and extract(None, "pdf")[1] == "failed" and extract(b"", "txt")[1] == "unsupported"
    data = [(mobi(1, b"", protection=1), "mobi"), (mobi(1, b""), "azw"), (b"short", "mobi"), (mobi(1, b""), "pdf"), (None, "mobi")]
    df = spark.createDataFrame(data, "content binary, ext string")
    assert [r.s for r in df.select(drm_status(F.col("content"), F.col("ext")).alias("s")).collect()] == ["suspected", "notDetected", "unknown", "unknown", "unknown"]


def test_scan_books_and_names(spark, rows, tmp_path):
    write(tmp_path / "a/The Story.epub", epub("ab"))
    write(tmp_path / "b/the story copy.epub", epub("ab"))
    engine = Engine(spark)
    assert rows(engine.scan_names([str(tmp_path)]), "score") == [(1.0,)]
    read, matches = engine.scan_books([str(tmp_path)])
    assert read.where("state = 'ready'").count() == 2 and rows(matches, "similarity") == [(1.0,)]


def test_images(spark, rows, tmp_path):
    def png(path, shade):
        raw = b"".join(b"\0" + bytes((x * 4 + shade) % 256 for x in range(64)) for _ in range(64))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        write(path, b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    png(tmp_path / "a.png", 0)
    png(tmp_path / "b.png", 1)
    write(tmp_path / "broken.png", "no image")
    result = Engine(spark).scan([str(tmp_path)], ScanOptions(similar_images=True))
    assert rows(result.images, "distance")[0] == (0,) and result.images.count() == 2


def test_cleanup(tmp_path):
    for name in ("a", "b", "c"):
        write(tmp_path / name, "equal" if name != "c" else "other")
    a, b, c = (str(tmp_path / x) for x in "abc")
    digest = review.file_sha256(a)
    assert review.preflight(a, [b], digest) == {} and review.preflight(a, [c], digest) == {c: "staleFile"} and review.preflight(c, [b], digest) == {c: "staleFile"}
    assert review.preflight(a, [a], digest) == {a: "staleFile"}
    (tmp_path / "trash").mkdir()
    assert review.move_to(str(tmp_path / "trash"), a, [b, c], digest) == {c: "staleFile"} and os.path.exists(a) and not os.path.exists(b)


BASE = datetime(2025, 1, 1)
SCHEMA = "session_no int, file_path string, device int, inode bigint, file_size bigint, modified_s bigint, modified_ns bigint, changed_s bigint, changed_ns bigint, observed_at timestamp, ingested_at timestamp, root string"


def stamp(session, path, size, late=0, seen=0, inode=1):
    at = BASE + timedelta(days=session, minutes=seen)
    return (session, path, 1, inode, size, 1, 1, 1, 1, at, at + timedelta(days=late), "/r")


def sessions(spark, *states):
    data = [(i + 1, s, BASE + timedelta(days=i + 1)) for i, s in enumerate(states)]
    return spark.createDataFrame(data, "session_no int, status string, started_at timestamp")


def test_changed_rows(spark, rows):
    data = [
        stamp(1, "/a", 1), stamp(1, "/a", 1), stamp(1, "/b", 1), stamp(2, "/b", 2), stamp(2, "/c", 5), stamp(3, "/a", 1), stamp(3, "/b", 1), stamp(3, "/c", 5), stamp(3, "/n", 1, inode=None),
        stamp(4, "/a", 9, seen=1), stamp(4, "/a", 1, seen=5), stamp(4, "/b", 3), stamp(4, "/n", 1, inode=None), stamp(5, "/b", 1), (None, "/x", *[None] * 10), (1, None, *[None] * 10),
    ]
    s = sessions(spark, "completed", "interrupted", "completed", "completed", "completed")
    found = changed_rows(spark.createDataFrame(data, SCHEMA), s)
    assert rows(found, "session_no", "file_path") == [(1, "/a"), (1, "/b"), (3, "/c"), (3, "/n"), (4, "/b"), (5, "/b")]
    assert rows(changed_rows(spark.createDataFrame([], SCHEMA), s)) == []


def test_incremental_runs(spark, rows, tmp_path):
    first = [stamp(1, "/a", 1), stamp(1, "/b", 1), stamp(2, "/a", 2)]
    scan = IncrementalScan(spark, f"file://{tmp_path}/ledger", STAMP)
    df = lambda data: spark.createDataFrame(data, SCHEMA)
    keys = lambda out: rows(out, "session_no", "file_path")
    assert keys(scan.run(df(first), sessions(spark, "completed", "running"))) == [(1, "/a"), (1, "/b")]
    assert keys(scan.run(df(first), sessions(spark, "completed", "running"))) == []
    grown = [*first, stamp(1, "/late", 1, late=20), stamp(2, "/b", 1), stamp(3, "/a", 2), stamp(3, "/new", 1)]
    done = sessions(spark, "completed", "completed", "completed")
    # a run that fails before its manifest leaves rows that the next run overwrites
    df(first).select("session_no", "file_path").write.parquet(f"file://{tmp_path}/ledger/runs/run=3")
    assert keys(scan.run(df(grown), done)) == [(1, "/late"), (2, "/a"), (3, "/new")]
    assert keys(scan.run(df(grown), done)) == [] and scan.manifest()["run"] == 4


def test_an_old_failed_session_holds_nothing_open(spark, tmp_path):
    """Only a session that has started and neither finished nor failed keeps the reread point back; a null status does."""
    df = spark.createDataFrame([stamp(1, "/a", 1), stamp(3, "/a", 2), stamp(4, "/a", 3)], SCHEMA)
    micros = lambda days: int((BASE + timedelta(days=days)).timestamp() * 1_000_000)
    scan = IncrementalScan(spark, f"file://{tmp_path}/ledger", STAMP)
    scan.run(df.where("session_no <= 1"), sessions(spark, "completed", "interrupted"))
    scan.run(df.where("session_no <= 3"), sessions(spark, "completed", "interrupted", "completed"))
    assert scan.manifest()["reread_from"] == micros(3)
    scan.run(df, sessions(spark, "completed", "needsRetry", "completed", "completed", None))
    assert scan.manifest()["reread_from"] == micros(4)
    other = IncrementalScan(spark, f"file://{tmp_path}/other", STAMP)
    other.run(df, sessions(spark, "completed", None, "completed", "completed"))
    assert other.manifest()["reread_from"] == micros(2)


def test_a_session_that_completes_late_counts_in_its_place(spark, rows, tmp_path):
    data = [stamp(1, "/a", 1), stamp(1, "/b", 1), stamp(2, "/a", 2), stamp(2, "/n", 1), stamp(3, "/a", 1), stamp(3, "/b", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    scan = IncrementalScan(spark, f"file://{tmp_path}/ledger", STAMP)
    assert rows(scan.run(df, sessions(spark, "completed", "interrupted", "completed")), "session_no", "file_path") == [(1, "/a"), (1, "/b")]
    # resumed: its own changes, and the one of the session after it that only now is one
    assert rows(scan.run(df, sessions(spark, "completed", "completed", "completed")), "session_no", "file_path") == [(2, "/a"), (2, "/n"), (3, "/a")]
    assert rows(scan.run(df, sessions(spark, "completed", "completed", "completed"))) == []


def test_a_failed_rename_is_no_run(spark, rows, tmp_path, monkeypatch):
    df, done = spark.createDataFrame([stamp(1, "/a", 1)], SCHEMA), sessions(spark, "completed")
    scan = IncrementalScan(spark, f"file://{tmp_path}/ledger", STAMP)
    path = scan._path

    def refusing(name):
        found, files = path(name)
        return found, type("Files", (), {"create": lambda s, *a: files.create(*a), "rename": lambda s, *a: False, "exists": lambda s, *a: files.exists(*a), "listStatus": lambda s, *a: files.listStatus(*a)})()

    monkeypatch.setattr(scan, "_path", refusing)
    with pytest.raises(OSError, match="could not be committed"):
        scan.run(df, done)
    monkeypatch.undo()
    assert scan.manifest()["run"] == 0 and rows(scan.run(df, done), "file_path") == [("/a",)] and rows(scan.run(df, done)) == []


def test_runs_read_only_their_sessions(spark, rows, tmp_path):
    """Landed by session and month of arrival: the files of a run are those of its new sessions and of late months."""
    from dupscape.operators.incremental import land

    data = [stamp(40 * s, f"/{p}", s if p == "a" else 1) for s in range(1, 7) for p in "abc"]
    df = land(spark.createDataFrame(data, SCHEMA), f"file://{tmp_path}/inbox")
    scan = IncrementalScan(spark, f"file://{tmp_path}/ledger", STAMP)
    states = lambda n: spark.createDataFrame([(40 * i, "completed", BASE + timedelta(days=40 * i)) for i in range(1, n + 1)], "session_no int, status string, started_at timestamp")
    for n in range(1, 7):
        assert rows(scan.run(df, states(n)), "file_path") == ([("/a",)] if n > 1 else [("/a",), ("/b",), ("/c",)])
    last = scan.manifest()
    assert scan._late(df, last).inputFiles() and len(scan._late(df, last).where("true").select("file_path").collect()) == 3
    assert spark.read.parquet(f"{scan.folder}/latest/run=6").count() == 3 and spark.read.parquet(f"{scan.folder}/seen/run=6").count() == 3


def test_stream_and_control(spark, rows, tmp_path):
    write(tmp_path / "in/a", "same")
    write(tmp_path / "in/b", "same")
    stream = content_stream(spark, f"file://{tmp_path}/in", per_trigger=1)
    start_groups(stream, "groups", f"file://{tmp_path}/cp").awaitTermination(120)
    assert rows(spark.table("groups"), "file_count", "reclaimable_bytes") == [(2, 4)]
    control = JobControl(spark)
    control.checkpoint()
    control.pause()
    control.cancel()
    with pytest.raises(InterruptedError):
        control.checkpoint("stage")


def test_books_beside_a_huge_file(spark, rows, tmp_path):
    """Only listed books are opened: a file of 3 GB beside one, and one that pretends to be a book, change nothing."""
    import zipfile

    from dupscape.plans.engine import Engine

    text = "<p>" + " ".join(f"word{i}" for i in range(400)) + "</p>"
    for name in ("a.epub", "b.epub"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for i in range(3):
                z.writestr(f"c{i}.xhtml", text)
    for name in ("film.bin", "film.mobi"):
        with open(tmp_path / name, "wb") as file:
            file.truncate(3 << 30)
    cache = f"file://{tmp_path}.cache"
    read, matches = Engine(spark).scan_books([str(tmp_path)], text_cache=cache)
    assert sorted((r.path.rsplit("/", 1)[1], r.state, r.title) for r in read.collect()) == [("a.epub", "ready", "a"), ("b.epub", "ready", "b"), ("film.mobi", "failed", "film")]
    assert matches.count() == 1
    again, _ = Engine(spark).scan_books([str(tmp_path)], text_cache=cache)
    assert again.where("state = 'ready'").count() == 2


def test_a_cancelled_scan_keeps_its_hashes(spark, rows, tmp_path, monkeypatch):
    from dupscape.operators.inventory import ScanOptions
    from dupscape.operators.state import SessionStore
    from dupscape.plans.engine import Engine

    for name in ("a", "b"):
        write(tmp_path / "in" / name, "equal" * 50_000)
    control, store = JobControl(spark), SessionStore(spark, str(tmp_path / "session"))
    asked = []

    def checkpoint(label=""):
        asked.append(label)
        if label == "full hashes":
            raise InterruptedError(label)

    monkeypatch.setattr(control, "checkpoint", checkpoint)
    with pytest.raises(InterruptedError):
        Engine(spark).scan([str(tmp_path / "in")], ScanOptions(), store, control=control)
    saved = store.load()
    assert asked == ["inventory", "hashes", "full hashes"] and saved["status"] == "interrupted"
    assert store.table(saved, "files").where("sample_hash is not null").count() == 2
    result = Engine(spark).scan([], ScanOptions(), store, resume=True)
    assert result.groups.count() == 1 and store.load()["status"] == "completed"
