"""Text of e-books from their bytes: EPUB, MOBI and simple PDF; and a quick look at copy protection."""

from __future__ import annotations

import io
import os
import posixpath
import re
import struct
import unicodedata
import zipfile
import zlib
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from dupscape.functions.text import READY_LENGTH

#: Compressions of a text record.
PLAIN, PALMDOC = 1, 2
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))


class Unsupported(ValueError):
    """A format or compression that is not read."""


class Encrypted(ValueError):
    """A protected book."""


def plain_text(markup: str) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", markup)
    text = re.sub(r"<[^>]+>", "\n", text)
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return text


def decoded(data: bytes) -> str:
    for encoding in ("utf-8", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def _attributes(tag: str) -> dict[str, str]:
    return {k.lower(): v for k, _, v in re.findall(r"""([\w:-]+)\s*=\s*(["'])(.*?)\2""", tag, re.S)}


def epub_text(data: bytes) -> str:
    """Chapters in reading order; without a usable order all pages in archive order. Paths cannot leave the archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        held = set(names)

        def page(name: str) -> str:
            return decoded(archive.read(name))

        order: list[str] = []
        if "META-INF/container.xml" in held:
            roots = [_attributes(t).get("full-path", "") for t in re.findall(r"<rootfile\b[^>]*>", page("META-INF/container.xml"))]
            package = next((r for r in roots if r in held), None)
            if package:
                text, base = page(package), posixpath.dirname(package)
                items = {a["id"]: a["href"] for a in map(_attributes, re.findall(r"<item\b[^>]*>", text)) if "id" in a and "href" in a}
                for ref in map(_attributes, re.findall(r"<itemref\b[^>]*>", text)):
                    target = posixpath.normpath(posixpath.join(base, unquote(items.get(ref.get("idref", ""), "").split("#")[0])))
                    if target in held and not target.startswith(("../", "/")):
                        order.append(target)
        order = order or [n for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))]
        if not order:
            raise ValueError("no readable pages")
        return "\n".join(plain_text(page(n)) for n in order)


def palmdoc(data: bytes) -> bytes:
    """Decompressed record: literals, short runs of raw bytes, a blank and a character, or a copy from before."""
    out, i = bytearray(), 0
    while i < len(data):
        b = data[i]
        i += 1
        if 1 <= b <= 8:
            out += data[i : i + b]
            i += b
        elif b >= 0xC0:
            out += bytes((0x20, b ^ 0x80))
        elif b >= 0x80:
            if i >= len(data):
                break
            pair = (b << 8 | data[i]) & 0x3FFF
            i += 1
            distance, length = pair >> 3, (pair & 7) + 3
            if not 0 < distance <= len(out):
                raise ValueError("broken back reference")
            for _ in range(length):
                out.append(out[-distance])
        else:
            out.append(b)
    return bytes(out)


def mobi_text(data: bytes) -> str:
    """Text records of a Palm database with plain or PalmDOC compression."""
    if len(data) < 80:
        raise ValueError("no header")
    (records,) = struct.unpack_from(">H", data, 76)
    if records < 1 or len(data) < 78 + 8 * records:
        raise ValueError("no record list")
    starts = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(records)] + [len(data)]
    if any(a > b for a, b in zip(starts, starts[1:])) or starts[0] + 14 > len(data):
        raise ValueError("broken record list")
    compression, texts, protection = struct.unpack_from(">H", data, starts[0])[0], struct.unpack_from(">H", data, starts[0] + 8)[0], struct.unpack_from(">H", data, starts[0] + 12)[0]
    if protection:
        raise Encrypted("protected")
    if compression not in (PLAIN, PALMDOC):
        raise Unsupported(f"compression {compression}")
    if not texts or texts >= records:
        raise ValueError("no text records")
    parts = [data[starts[i] : starts[i + 1]] for i in range(1, texts + 1)]
    return plain_text(decoded(b"".join(parts if compression == PLAIN else map(palmdoc, parts))))


def pdf_text(data: bytes) -> str:
    """Strings shown by the content streams of simple PDFs (literal and hexadecimal strings, Flate or no filter)."""
    if not data.startswith(b"%PDF"):
        raise ValueError("no PDF header")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise Encrypted("protected")
    lines = []
    for head, body in re.findall(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"Tj" in body or b"TJ" in body:
            for shown in re.findall(rb"\[(?:[^\]\\]|\\.)*\]\s*TJ|\((?:[^()\\]|\\.)*\)\s*(?:Tj|'|\")|<[0-9A-Fa-f\s]+>\s*Tj", body, re.S):
                text = b"".join(_literal(s[1:-1]) for s in re.findall(rb"\((?:[^()\\]|\\.)*\)", shown, re.S))
                text += b"".join(bytes.fromhex(h.decode()) for h in re.findall(rb"<((?:[0-9A-Fa-f]{2})+)>", shown))
                lines.append(decoded(text))
    return "\n".join(lines)


def _literal(data: bytes) -> bytes:
    marks = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def one(m: re.Match) -> bytes:
        found = m.group(1)
        return bytes([int(found, 8) & 255]) if found[:1].isdigit() else marks.get(found, found)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, data, flags=re.S)


READERS = {"epub": epub_text, "mobi": mobi_text, "azw": mobi_text, "azw3": mobi_text, "pdf": pdf_text}


#: Bytes of one book that are read at most; a larger file is no e-book, and is a failed one of its own.
LARGEST = 1 << 30


def book_title(text: str | None, path: str) -> str:
    """The first line, if it has 2 to 100 characters, else the file's name without its extension."""
    line = (text or "").split("\n", 1)[0].strip()
    return line if 2 <= len(line) <= 100 else posixpath.splitext(posixpath.basename(path))[0]


def read_book(path: str, kind: str) -> tuple[str | None, str, str | None, str]:
    """``(text, state, detail, title)`` of the book at ``path``, opened here; links are not followed."""
    try:
        with os.fdopen(os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as file:
            if os.fstat(file.fileno()).st_size > LARGEST:
                return None, "failed", f"larger than {LARGEST} bytes", book_title(None, path)
            data = file.read()
    except OSError as error:
        return None, "failed", f"{type(error).__name__}: {error.strerror}", book_title(None, path)
    text, state, detail = extract(data, kind)
    return text, state, detail, book_title(text, path)


BOOK = "text string, state string, detail string, title string"


def read_books(files: DataFrame) -> DataFrame:
    """``files(path, ext, ...)`` with ``text``, ``state``, ``detail`` and ``title``, each book opened by the executor that reads it.

    Only listed paths are opened, one at a time, and their bytes never leave the task: no content is shuffled.
    """

    @pandas_udf(BOOK)
    def opened(paths: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_book(p, k) for p, k in zip(paths, kinds)], columns=["text", "state", "detail", "title"])

    return files.withColumn("_x", opened("path", "ext")).select("*", "_x.*").drop("_x")


def extract(data: bytes | None, kind: str) -> tuple[str | None, str, str | None]:
    """``(text, state, detail)`` of one book; a broken file is a state, never an error."""
    if data is None or kind not in READERS:
        return None, "unsupported" if data is not None else "failed", None
    try:
        text = READERS[kind](data)
    except Encrypted as error:
        return None, "encrypted", str(error)
    except Unsupported as error:
        return None, "unsupported", str(error)
    except Exception as error:  # noqa: BLE001 - any malformed file is a result of its own
        return None, "failed", f"{type(error).__name__}: {error}"
    text = re.sub(r"\s+", " ", re.sub(r"(?m)^[ \t]*\d{1,5}[ \t]*$", " ", unicodedata.normalize("NFKC", text))).strip()
    if len(text) < READY_LENGTH:
        return text, "scannedPDF" if kind == "pdf" else "tooShort", None
    return text, "ready", None


@pandas_udf(StructType([StructField(c, StringType()) for c in ("text", "state", "detail")]))
def extracted(contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(c, k) for c, k in zip(contents, kinds)], columns=["text", "state", "detail"])


def extract_books(files: DataFrame, content: str = "content", kind: str = "ext") -> DataFrame:
    """``files`` with ``text``, ``state`` and ``detail`` instead of the content."""
    return files.withColumn("_x", extracted(F.col(content), F.col(kind))).select("*", "_x.text", "_x.state", "_x.detail").drop("_x", content)


def drm_status(content: Column, ext: Column) -> Column:
    """``suspected`` or ``notDetected`` for MOBI and AZW, by the first record's protection field; else ``unknown``. In the JVM."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("bigint")
    start = number(79, 4)
    field = F.hex(F.substring(content, start.cast("int") + 13, F.lit(2)))
    known = ext.isin("mobi", "azw", "azw3") & (F.octet_length(content) >= 94) & (F.octet_length(content) >= start + 14)
    return F.when(F.coalesce(known, F.lit(False)), F.when(field == "0000", "notDetected").otherwise("suspected")).otherwise("unknown")
