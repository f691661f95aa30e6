"""Text of PDF files whose fonts use a common one-byte encoding; other PDFs need another provider."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TEXT = re.compile(rb"\bBT\b(.*?)\bET\b", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|T\*|\b(?:Td|TD|Tm)\b|-?\d+(?:\.\d+)?|['\"]", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _stream(body: bytes) -> tuple[bytes, bytes]:
    """(dictionary, data) of an object with a stream."""
    m = _STREAM.match(body)
    if not m:
        return body, b""
    return m[1], zlib.decompressobj().decompress(m[2]) if b"/FlateDecode" in m[1] else m[2]


def _objects(raw: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(raw)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            head, data = _stream(body)
            first = int(re.search(rb"/First\s+(\d+)", head)[1])
            numbers = [int(x) for x in data[:first].split()]
            ends = [*numbers[3::2], len(data) - first]
            found |= {n: data[first + a : first + b] for n, a, b in zip(numbers[::2], numbers[1::2], ends, strict=False)}
    return found


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "ignore") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def content_text(content: bytes) -> str:
    """The strings that a page's content shows, with line breaks where it moves to a new line."""
    out: list[str] = []
    for block in _TEXT.findall(content):
        line: list[str] = []
        for t in _SHOWN.findall(block):
            if t[:1] in b"(<":
                line.append(_string(t))
            elif t in (b"T*", b"Td", b"TD", b"Tm", b"'", b'"') and line and line[-1] != "\n":
                line.append("\n")
        out.append("".join(line).strip("\n"))
    return "\n".join(x for x in out if x)


def pdf_pages(raw: bytes) -> list[str]:
    """The texts of the pages, in order; ValueError if this is no PDF."""
    if not raw.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    objects = _objects(raw)
    kids = {n: [int(x) for x in _REF.findall(m[1])] for n, body in objects.items() if (m := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S))}
    below = {k for held in kids.values() for k in held}

    def leaves(n: int) -> list[int]:
        return [x for k in kids[n] for x in leaves(k)] if n in kids else [n]

    pages = [x for n in kids if n not in below for x in leaves(n)] or sorted(n for n, body in objects.items() if re.search(rb"/Type\s*/Page\b", body))
    texts = []
    for n in pages:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects.get(n, b""), re.S)
        held = [objects.get(int(x), b"") for x in _REF.findall(m[1])] if m else []
        texts.append(content_text(b"\n".join(_stream(body)[1] for body in held)))
    return texts
