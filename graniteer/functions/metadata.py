"""Descriptive fields inside images, PDF and DOCX files, as map<string,string>; unreadable files have none."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from datetime import datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PDF_FIELDS, DOCX_FIELDS = ("title", "author", "creator", "producer"), ("title", "subject", "creator", "keywords", "description")
MAKE, MODEL, CHANGED, EXIF_IFD, TAKEN, DIGITISED = 0x010F, 0x0110, 0x0132, 0x8769, 0x9003, 0x9004


def _tiff_of(content: bytes) -> bytes | None:
    """The TIFF block of a JPEG's APP1 segment or a PNG's eXIf chunk."""
    if content.startswith(b"\xff\xd8"):
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
            n = int.from_bytes(content[at + 2 : at + 4], "big")
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return content[at + 10 : at + 2 + n]
            at += 2 + max(n, 2)
    elif content.startswith(b"\x89PNG\r\n\x1a\n"):
        at = 8
        while at + 8 <= len(content):
            n = int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] == b"eXIf":
                return content[at + 8 : at + 8 + n]
            at += 12 + n
    return None


def _directory(tiff: bytes, at: int, e: str) -> dict[int, str | int]:
    """Text (type 2) and single numbers (types 3 and 4) of one image file directory."""
    out: dict[int, str | int] = {}
    for k in range(struct.unpack_from(e + "H", tiff, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", tiff, at + 2 + 12 * k)
        value = at + 10 + 12 * k
        if kind == 2:
            start = value if n <= 4 else struct.unpack_from(e + "I", tiff, value)[0]
            out[tag] = tiff[start : start + n].split(b"\0")[0].decode("utf-8", "replace")
        elif kind in (3, 4) and n == 1:
            out[tag] = struct.unpack_from(e + ("H" if kind == 3 else "I"), tiff, value)[0]
    return out


def image_fields(content: bytes) -> dict[str, str]:
    """make and model are quoted, datetime is RFC 3339 (taken, else digitised, else changed; as UTC)."""
    tiff = _tiff_of(content)
    e = {b"II": "<", b"MM": ">"}.get((tiff or b"")[:2])
    if not e:
        return {}
    try:
        tags = _directory(tiff, struct.unpack_from(e + "I", tiff, 4)[0], e)
        if isinstance(tags.get(EXIF_IFD), int):
            tags = _directory(tiff, tags[EXIF_IFD], e) | tags
    except struct.error:
        return {}
    out = {name: f'"{tags[tag]}"' for name, tag in (("make", MAKE), ("model", MODEL)) if isinstance(tags.get(tag), str)}
    for tag in (TAKEN, DIGITISED, CHANGED):
        try:
            out["datetime"] = datetime.strptime(str(tags[tag]), "%Y:%m:%d %H:%M:%S").strftime("%Y-%m-%dT%H:%M:%SZ")
            break
        except (KeyError, ValueError):
            continue
    return out


def _pdf_objects(content: bytes, number: int) -> bytes | None:
    """The last body of an object, from the file itself or from a compressed object stream."""
    direct = [m.end() for m in re.finditer(rb"(?<!\d)%d[ \r\n\t]+\d+[ \r\n\t]+obj" % number, content)]
    if direct:
        return content[direct[-1] : content.find(b"endobj", direct[-1])]
    for m in re.finditer(rb"/Type\s*/ObjStm", content):
        start = content.rfind(b"obj", 0, m.start())
        head = content[start : content.find(b"stream", m.start())]
        first, n = re.search(rb"/First\s+(\d+)", head), re.search(rb"/N\s+(\d+)", head)
        body = re.match(rb"stream\r?\n", content[start + len(head) :])
        if not (first and n and body):
            continue
        try:
            data = zlib.decompressobj().decompress(content[start + len(head) + body.end() :])
        except zlib.error:
            continue
        at = int(first[1])
        table = [int(x) for x in data[:at].split()[: 2 * int(n[1])]]
        places = dict(zip(table[::2], table[1::2], strict=False))
        if number in places:
            ends = [p for p in places.values() if p > places[number]]
            return data[at + places[number] : at + min(ends) if ends else None]
    return None


def _pdf_string(raw: bytes) -> str:
    """A literal (...) or hexadecimal <...> string at the start of raw."""
    if raw[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw[1 : raw.find(b">")])
        out = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        out, depth, i = bytearray(), 1, 1
        while i < len(raw):
            c = raw[i : i + 1]
            if c == b"\\":
                octal = re.match(rb"[0-7]{1,3}", raw[i + 1 : i + 4])
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    i += 1 + len(octal[0])
                    continue
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}.get(raw[i + 1 : i + 2], raw[i + 1 : i + 2])
                i += 2
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
            i += 1
        out = bytes(out)
    if out[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return out.decode("utf-16", "replace")
    return out[3:].decode("utf-8", "replace") if out[:3] == b"\xef\xbb\xbf" else out.decode("latin-1")


def pdf_fields(content: bytes) -> dict[str, str]:
    """Of the information dictionary that the last trailer names; encrypted files have none."""
    info = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", content)
    if not info or re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        return {}
    body, out = _pdf_objects(content, int(info[-1])) or b"", {}
    for name in PDF_FIELDS:
        m = re.search(rb"/%s\s*(?=[(<])" % name.title().encode(), body)
        value = _pdf_string(body[m.end() :]) if m else ""
        if value:
            out[name] = value
    return out


def docx_fields(content: bytes, most: int = 0) -> dict[str, str]:
    """Core properties; none where they are larger than `most` bytes (0: no limit)."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            part = z.getinfo("docProps/core.xml")
            if 0 < most < part.file_size:
                return {}
            root = ElementTree.fromstring(z.read(part))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, NotImplementedError, RuntimeError, EOFError):
        return {}
    found = {child.tag.rpartition("}")[2]: child.text for child in root}
    return {k: found[k] for k in DOCX_FIELDS if found.get(k)}


def fields(content: bytes, kind: str, most: int = 0) -> dict[str, str]:
    if kind in ("image/jpeg", "image/png"):
        return image_fields(content[:most] if most > 0 else content)
    if kind == "application/pdf":
        return {} if 0 < most < len(content) else pdf_fields(content)
    return docx_fields(content, most) if kind in (DOCX, "application/zip") else {}


def metadata(content: Column, kind: Column, most: int = 1 << 20) -> Column:
    """Only files of the kinds that can have fields cross to Python."""

    @F.pandas_udf("map<string,string>")
    def run(values: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([(fields(bytes(v), k, most) or None) if v is not None else None for v, k in zip(values, kinds, strict=True)], dtype=object)

    return run(F.when(kind.isin("image/jpeg", "image/png", "application/pdf", "application/zip", DOCX), content), kind)
