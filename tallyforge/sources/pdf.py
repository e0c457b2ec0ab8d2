"""Text that PDF files carry themselves, page by page; and words from an engine that the caller brings.

A small reader of the parts that receipts use: objects, Flate streams, page order by the
page tree, and the strings of the text operators. Fonts with their own encodings, encrypted
files and object streams are not read: their text comes out empty, and the next rung of the
ladder takes over.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = "path string, page int, text string"
WORDS = "path string, page int, i int, text string, left int, top int, width int, height int, conf double, line_num int"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_SHOWN = re.compile(rb"(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|\[((?:\\.|\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(T\*|\bT[dD]\b|\bTm\b|\bET\b)", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|-?\d+(?:\.\d+)?", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
#: Space between strings of one array, in thousandths of the font, that counts as a blank.
GAP = 200


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
    one = lambda m: named.get(m[1], bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else m[1])
    return _ESCAPE.sub(one, raw[1:-1]).decode("latin-1")


def shown_text(content: bytes) -> str:
    """The strings that a page's content shows, a new line wherever the place is moved."""
    out: list[str] = []
    for m in _SHOWN.finditer(content):
        if m[1]:
            out.append(_string(m[1]))
        elif m[2] is not None:
            for part in _STRING.findall(m[2]):
                if part[:1] in b"(<":
                    out.append(_string(part))
                elif float(part) < -GAP:
                    out.append(" ")
        elif out and not out[-1].endswith("\n"):
            out.append("\n")
    return "".join(out).strip("\n")


def page_texts(data: bytes) -> list[str]:
    """The text of each page of a file, in the order of its page tree; none for what isn't a PDF."""
    if not data[:1024].lstrip().startswith(b"%PDF"):
        return []
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        if b"FlateDecode" not in body[: m.start()]:
            return m[1]
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""

    refs = lambda key, body: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body, re.S) or [b"", b""])[1])]
    pages: list[bytes] = []
    seen: set[int] = set()

    def walk(n: int) -> None:
        body = objects.get(n, b"")
        if n in seen:
            return
        seen.add(n)
        if re.search(rb"/Type\s*/Pages\b", body):
            for kid in refs(rb"/Kids", body):
                walk(kid)
        elif re.search(rb"/Type\s*/Page\b", body):
            pages.append(b"\n".join(stream(objects.get(c, b"")) for c in refs(rb"/Contents", body)))

    children = {k for body in objects.values() if re.search(rb"/Type\s*/Pages\b", body) for k in refs(rb"/Kids", body)}
    for n, body in objects.items():
        if re.search(rb"/Type\s*/Pages?\b", body) and n not in children:
            walk(n)
    return [shown_text(p) for p in pages]


def pdf_pages(files: DataFrame) -> DataFrame:
    """path, page (from 1), text of every page of files (path, content); files that can't be read have no rows."""

    def run(batches):
        for b in batches:
            rows = [(p, i + 1, t) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, t in enumerate(page_texts(c or b""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["path", "page", "text"])

    return files.select("path", "content").mapInArrow(run, PAGES)


def pdf_texts(files: DataFrame, headers: bool = False) -> DataFrame:
    """path, text of files: pages joined by a blank, or under a heading each."""
    pages = F.array_sort(F.collect_list(F.struct("page", "text")))
    one = lambda p: F.concat(F.lit("=== PAGE "), p["page"].cast("string"), F.lit(" ===\n"), p["text"]) if headers else p["text"]
    return pdf_pages(files).groupBy("path").agg(F.array_join(F.transform(pages, one), "\n" if headers else " ").alias("text"))


def read_words(files: DataFrame, engine: Callable[[bytes], list[list[dict]]]) -> DataFrame:
    """Words with places of files (path, content) by an engine from the caller: bytes to pages of words (text, left, top, width, height, conf, line_num)."""

    def run(batches):
        for b in batches:
            rows = [(p, n + 1, i, w["text"], w["left"], w["top"], w["width"], w["height"], float(w["conf"]), w["line_num"]) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, page in enumerate(engine(c or b"")) for i, w in enumerate(page)]
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in WORDS.split(", ")])

    return files.select("path", "content").mapInArrow(run, WORDS)
