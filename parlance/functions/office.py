"""Files of block rows: word-processor and page documents, and audio files, by the standard library alone."""

from __future__ import annotations

import io
import re
import struct
import wave
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: Points of a heading by level, of a note and of other text; a note is grey.
SIZES = {1: 20, 2: 16, 3: 13, 4: 12}
NOTE, TEXT = 10, 11
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


def points(kind: str, level: int) -> int:
    return SIZES.get(level, TEXT) if kind == "heading" else NOTE if kind == "note" else TEXT


def docx(blocks: list[tuple[str, int, str]]) -> bytes:
    """A word-processor document of (kind, level, text) blocks; characters that XML cannot hold are dropped."""
    body = []
    for kind, level, text in blocks:
        look = f'<w:sz w:val="{2 * points(kind, level)}"/>' + ("<w:b/>" if kind == "heading" else '<w:color w:val="808080"/>' if kind == "note" else "")
        lines = '<w:br/>'.join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in _NO_XML.sub("", text).split("\n"))
        body.append(f"<w:p><w:r><w:rPr>{look}</w:rPr>{lines}</w:r></w:p>")
    main = '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(body) + "</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATIONS), ("word/document.xml", main)):
            z.writestr(zipfile.ZipInfo(name), content.encode())
    return out.getvalue()


def docx_text(data: bytes) -> list[str]:
    """The paragraphs of a word-processor document."""
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join("\n" if x.tag == space + "br" else x.text or "" for x in p.iter() if x.tag in (space + "t", space + "br")) for p in root.iter(space + "p")]


WIDTH, HEIGHT, MARGIN = 595, 842, 56  # A4 in points


def _wrapped(text: str, size: int) -> list[str]:
    """Lines that fit the page, by an average width of half the size; words that are longer are cut."""
    most = max(1, int((WIDTH - 2 * MARGIN) / (size * 0.5)))
    out = []
    for line in text.split("\n"):
        held = ""
        for word in line.split(" "):
            while len(word) > most:
                out += [held] * bool(held) + [word[:most]]
                held, word = "", word[most:]
            joined = f"{held} {word}" if held else word
            if len(joined) > most:
                out.append(held)
                joined = word
            held = joined
        out.append(held)
    return out


def pdf(blocks: list[tuple[str, int, str]]) -> bytes:
    """A page document (A4) of (kind, level, text) blocks; characters beyond Windows-1252 show as question marks."""
    pages, at = [[]], HEIGHT - MARGIN
    for kind, level, text in blocks:
        size = points(kind, level)
        for line in _wrapped(text, size):
            if at - size * 1.4 < MARGIN:
                pages.append([])
                at = HEIGHT - MARGIN
            at -= size * 1.4
            shown = re.sub(rb"([\\()])", rb"\\\1", line.encode("cp1252", "replace"))
            font, grey = (2 if kind == "heading" else 1), ("0.5" if kind == "note" else "0")
            pages[-1].append(b"BT /F%d %d Tf %s g %d %.1f Td (%s) Tj ET" % (font, size, grey.encode(), MARGIN, at, shown))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages))), len(pages))]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % name for name in (b"Helvetica", b"Helvetica-Bold")]
    for i, page in enumerate(pages):
        content = zlib.compress(b"\n".join(page))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, 6 + 2 * i))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(content), content))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))


def pdf_text(data: bytes) -> list[str]:
    """The shown lines of a page document, by way of its table of places, page tree and content streams, as ``pdf`` lays them out."""
    table = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data)[1])
    places = [int(p) for p in re.findall(rb"(\d{10}) \d{5} [nf] \n", data[table:])]

    def find(number: int, pattern: bytes):
        if (found := re.compile(b"%d 0 obj\n" % number + pattern).match(data, places[number])) is None:
            raise ValueError(f"no such object at place {number}")
        return found

    out = []
    catalogue = int(re.search(rb"/Root (\d+) 0 R", data[table:])[1])
    pages = int(find(catalogue, rb"<< /Type /Catalog /Pages (\d+) 0 R >>\nendobj")[1])
    for page in re.findall(rb"(\d+) 0 R", find(pages, rb"<< /Type /Pages /Kids \[([0-9R ]*)\] /Count \d+ >>\nendobj")[1]):
        content = find(int(page), rb"<< /Type /Page .* /Contents (\d+) 0 R >>\nendobj")
        stream = find(int(content[1]), rb"<< /Length (\d+) /Filter /FlateDecode >>\nstream\n")
        shown = zlib.decompress(data[stream.end() : stream.end() + int(stream[1])])
        out += [re.sub(rb"(?s)\\(.)", rb"\1", x).decode("cp1252") for x in re.findall(rb"(?s)\(((?:[^\\()]|\\.)*)\) Tj ET", shown)]
    return out


def wav(pcm: bytes, rate: int = 16_000) -> bytes:
    """An audio file of one channel of 16-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm)
    return out.getvalue()


def _blocks(rows) -> list[tuple[str, int, str]]:
    return [(b["kind"], b["level"] or 0, b["text"] or "") for b in rows]


@F.pandas_udf(BinaryType())
def docx_file(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda rows: docx(_blocks(rows)))


@F.pandas_udf(BinaryType())
def pdf_file(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda rows: pdf(_blocks(rows)))


@F.pandas_udf(StringType())
def docx_paragraphs(files: pd.Series) -> pd.Series:
    """The text of word-processor files, a line per paragraph."""
    return files.map(lambda data: "\n".join(docx_text(bytes(data))))


@F.pandas_udf(StringType())
def pdf_lines(files: pd.Series) -> pd.Series:
    """The text of page files, a line per shown line."""
    return files.map(lambda data: "\n".join(pdf_text(bytes(data))))


def wav_file(pcm: Column, rate: int = 16_000) -> Column:
    """``wav`` as a column of built-ins: no batch of samples goes through Python."""
    def number(n):  # 32 bits, the lowest byte first
        digits = F.lpad(F.hex(n.cast("long")), 8, "0")
        return F.unhex(F.concat(*(F.substring(digits, at, 2) for at in (7, 5, 3, 1))))

    size = F.octet_length(pcm)
    shape = struct.pack("<4s4sIHHIIHH4s", b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data")
    return F.concat(F.lit(b"RIFF"), number(size + 36), F.lit(shape), number(size), pcm)


def document_files(blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, docx, pdf) of block rows (keys, block, kind, level, text)."""
    row = F.struct("block", "kind", F.col("level").cast("int").alias("level"), "text")
    g = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("b"))
    return g.select(*keys, docx_file("b").alias("docx"), pdf_file("b").alias("pdf"))
