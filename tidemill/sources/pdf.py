"""Text of PDF documents, for tables that arrive as pages.

Reads the page contents of a document whose text is shown by the ordinary operators (Tj, TJ, ', ") in simple fonts or in
two-byte Unicode strings, uncompressed or compressed with Flate.  A new line begins where the text position moves down.

Defined results: bytes that are no PDF, and pages of pictures, give no lines; encrypted documents are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STREAM = re.compile(rb"(<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>)\s*stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_PART = re.compile(
    rb"\((?P<text>(?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>\[)|(?P<shut>\])|(?P<number>[-+]?\d*\.?\d+)|(?P<word>[A-Za-z'\"*]+)", re.DOTALL
)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(raw: bytes) -> bytes:
    def one(found: re.Match) -> bytes:
        body = found.group(1)
        return bytes([int(body, 8) & 255]) if body.isdigit() else b"" if body in (b"\n", b"\r", b"\r\n") else _ESCAPE.get(body, body)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.DOTALL)


def _text(raw: bytes, wide: bool) -> str:
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("utf-16-be", "replace") if wide and len(raw) % 2 == 0 else raw.decode("latin-1")


def page_text(content: bytes) -> str:
    """Text of one content stream."""
    lines, now, numbers = [], [], []
    shown: list[str] = []

    def end() -> None:
        if now:
            lines.append("".join(now))
            now.clear()

    for part in _PART.finditer(content):
        kind = part.lastgroup
        if kind == "text":
            shown.append(_text(_unescaped(part.group(kind)), False))
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", part.group(kind))
            shown.append(_text(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), len(digits) % 4 == 0))
        elif kind == "number":
            numbers.append(float(part.group(kind)))
        elif kind == "word":
            word = part.group(kind)
            if word in (b"Td", b"TD") and len(numbers) >= 2 and numbers[-1] != 0 or word in (b"T*", b"BT", b"ET", b"Tm"):
                end()
            if word in (b"'", b'"'):
                end()
            if word in (b"Tj", b"TJ", b"'", b'"'):
                now += shown
            shown, numbers = [], []
    end()
    return "\n".join(lines)


def pdf_text(data: bytes | None) -> str:
    """Text of all content streams of a document, in the order of the file."""
    if not data or not bytes(data[:1024]).lstrip().startswith(b"%PDF"):
        return ""
    out = []
    for head, body in _STREAM.findall(bytes(data)):
        if re.search(rb"/(?:Subtype|FontFile\d?|Length1|Type\s*/(?:XRef|ObjStm))\b", head):
            continue
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        text = page_text(body)
        if text.strip():
            out.append(text)
    return "\n".join(out)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``text`` of the documents in a folder, blank lines removed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = ["\n".join(line for line in pdf_text(data).split("\n") if line.strip()) for data in part["content"]]
            yield pd.DataFrame({"path": part["path"], "text": texts})

    files = spark.read.format("binaryFile").load(path).select("path", F.col("content"))
    return files.mapInPandas(run, "path string, text string")


def written(lines: list[str], compressed: bool = True) -> bytes:
    """A document of one page that shows some lines, for tests and exports."""
    shown = b" ".join(b"<" + line.encode("utf-16-be").hex().encode() + b"> Tj 0 -14 Td" for line in lines)
    body = b"BT /F1 12 Tf 50 700 Td " + shown + b" ET"
    packed = zlib.compress(body) if compressed else body
    head = b"<< /Length " + str(len(packed)).encode() + (b" /Filter /FlateDecode" if compressed else b"") + b" >>"
    return b"%PDF-1.4\n1 0 obj\n" + head + b"\nstream\n" + packed + b"\nendstream\nendobj\n%%EOF\n"
