"""Blocks to files: Markdown, HTML, JSON records and DOCX bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_DOC = '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def json_records(blocks: DataFrame) -> DataFrame:
    """(doc_id, record): a JSON object for each document with its blocks in order."""
    block = F.struct("seq", F.format_string("b%04d", F.col("seq") + 1).alias("id"), "type", "level", "content", F.round("importance", 1).alias("importance_score"))
    return blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks")).select("doc_id", F.to_json(F.struct("doc_id", F.size("blocks").alias("block_count"), "blocks")).alias("record"))


def write_text(rows: DataFrame, column: str, folder: str) -> None:
    """One text row a document, written as text below doc_id=... folders."""
    rows.select(F.col(column).alias("value"), "doc_id").write.mode("overwrite").partitionBy("doc_id").text(folder)


def _paragraph(text: str, style: str = "", bold: bool = False) -> str:
    props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f'<w:p>{props}<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def docx_bytes(blocks: list[tuple[str, int, str]]) -> bytes:
    """A DOCX file of (type, level, content) blocks."""
    parts = []
    for kind, level, content in blocks:
        if kind in ("heading", "entity"):
            parts.append(_paragraph(content, f"Heading{max(level, 1)}"))
        elif kind == "list":
            parts += [_paragraph(x, "ListBullet") for x in content.split("\n")]
        elif kind == "table":
            rows = [[c.strip() for c in r.strip("|").split("|")] for r in content.split("\n")]
            parts.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>")
        elif kind == "quote":
            parts.append(_paragraph(content, "Quote"))
        else:
            parts += [_paragraph(x, "", kind in ("warning", "callout")) for x in content.split("\n")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", _DOC.format("".join(parts)))):
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def to_docx(blocks: DataFrame) -> DataFrame:
    """(doc_id, docx): a DOCX file of each document; a document's blocks come to one row first."""
    own = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "level", "content"))).alias("blocks"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [docx_bytes([(b["type"], b["level"] or 0, b["content"] or "") for b in bs]) for bs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "docx": pa.array(files, pa.binary())})

    return own.mapInArrow(run, "doc_id long, docx binary")
