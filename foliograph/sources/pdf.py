"""Text of simple PDF files: content streams, plain or deflated, with text in single-byte or UTF-16 strings.

Fonts with encodings of their own (`ToUnicode` maps), encrypted files and scanned pages are
beyond it; a file without any text is an error, as for a parser that finds none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<(?!<)|>(?!>)|<<[^<>]*>>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
TOKEN = re.compile(rb"\((?P<text>)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>\[)|(?P<close>\])|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<name>/[^\s()<>\[\]{}/%]*)|(?P<operator>[A-Za-z'\"*]+[0-9*]*)|<<|>>|%[^\r\n]*")
ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}
#: A gap in a shown array from which on words are apart, in thousandths of the font size.
WORD_GAP = 200


def _streams(raw: bytes) -> Iterator[bytes]:
    for m in STREAM.finditer(raw):
        head, body = m["head"], m["body"]
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"BT" in body and b"/Image" not in head:
            yield body


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string behind an opening parenthesis, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        if c == 0x5C and at + 1 < len(data):
            follows = data[at + 1]
            octal = re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4])
            if octal:
                out.append(int(octal.group(), 8) & 255)
                at += 1 + octal.end()
            elif follows in b"\r\n":
                at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            else:
                out += ESCAPES.get(follows, bytes([follows]))
                at += 2
            continue
        depth += (c == 0x28) - (c == 0x29)
        at += 1
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def _decoded(value: bytes) -> str:
    return value[2:].decode("utf-16-be", "replace") if value.startswith(b"\xfe\xff") else value.decode("cp1252", "replace")


def _shown(data: bytes) -> str:
    """The text that a content stream shows, a line for each line start."""
    out: list[str] = []
    operands: list[str | float] = []
    at = 0
    while found := TOKEN.search(data, at):
        at = found.end()
        kind = found.lastgroup
        if kind == "text":
            value, at = _literal(data, at)
            operands.append(_decoded(value))
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", found["hex"])
            operands.append(_decoded(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())))
        elif kind == "number":
            operands.append(float(found["number"]))
        elif kind == "operator":
            name = found["operator"]
            if name in (b"T*", b"'", b'"') or name in (b"Td", b"TD") and operands[-1:] != [0.0] or name in (b"Tm", b"ET"):
                out.append("\n")
            if name in (b"Tj", b"TJ", b"'", b'"'):
                for x in operands:
                    if isinstance(x, str):
                        out.append(x)
                    elif name == b"TJ" and x <= -WORD_GAP:
                        out.append(" ")
            operands.clear()
    return "".join(out)


def pdf_text(raw: bytes) -> str:
    if not raw.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF file")
    if b"/Encrypt" in raw:
        raise ValueError("the file is encrypted")
    lines = (line.strip() for data in _streams(raw) for line in _shown(data).split("\n"))
    text = "\n".join(line for line in lines if line)
    if not text:
        raise ValueError("no text found")
    return text
