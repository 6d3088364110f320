"""Runs, styles and theme of DOCX files as rows, for the import of designs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
RUNS = "doc_id long, par int, pos int, style string, bold boolean, size double, color string, font string, highlight string"
SAID = "doc_id long, h1_color string, h1_font string, text_color string, text_font string, accent1 string, dark1 string, light1 string, page_color string"


def _part(z: zipfile.ZipFile, start: str) -> ElementTree.Element | None:
    name = next((n for n in z.namelist() if n.startswith(start)), None)
    try:
        return ElementTree.fromstring(z.read(name)) if name else None
    except ElementTree.ParseError:
        return None


def _get(node: ElementTree.Element | None, path: str, key: str = f"{_W}val") -> str | None:
    found = node.find(path) if node is not None else None
    return found.get(key) if found is not None else None


def _look(props: ElementTree.Element | None) -> tuple[str | None, str | None]:
    """Colour, where it is one of six digits, and font of run properties."""
    color = _get(props, f"{_W}color")
    return color if color and re.fullmatch("[0-9A-Fa-f]{6}", color) else None, _get(props, f"{_W}rFonts", f"{_W}ascii")


def _runs(z: zipfile.ZipFile) -> Iterator[tuple]:
    root, styles = _part(z, "word/document.xml"), _part(z, "word/styles.xml")
    names = {s.get(f"{_W}styleId"): _get(s, f"{_W}name") for s in (styles.iter(f"{_W}style") if styles is not None else ())}
    body = root.find(f"{_W}body") if root is not None else None
    for par, p in enumerate(body.findall(f"{_W}p") if body is not None else ()):
        style = _get(p, f"{_W}pPr/{_W}pStyle")
        for pos, run in enumerate(p.findall(f"{_W}r")):
            props = run.find(f"{_W}rPr")
            bold = props.find(f"{_W}b") if props is not None else None
            half = _get(props, f"{_W}sz")
            color, font = _look(props)
            yield par, pos, names.get(style) or style, bold is not None and bold.get(f"{_W}val") not in ("0", "false"), int(half) / 2 if half and half.isdigit() else None, color, font, _get(props, f"{_W}highlight")


def _said(z: zipfile.ZipFile) -> tuple:
    styles, theme = _part(z, "word/styles.xml"), _part(z, "word/theme/")
    by_name = {(_get(s, f"{_W}name") or "").lower(): s.find(f"{_W}rPr") for s in (styles.iter(f"{_W}style") if styles is not None else ())}

    def scheme(tag: str) -> str | None:
        own = f".//{_A}clrScheme/{_A}{tag}/{_A}"
        return _get(theme, own + "srgbClr", "val") or _get(theme, own + "sysClr", "lastClr")

    settings = z.read("word/settings.xml").decode("utf-8", "ignore") if "word/settings.xml" in z.namelist() else ""
    paper = re.search(r'<w:background[^>]*w:color="([0-9A-Fa-f]{6})"', settings)
    return *_look(by_name.get("heading 1")), *_look(by_name.get("normal")), scheme("accent1"), scheme("dk1"), scheme("lt1"), paper[1] if paper else None


def _mapped(docs: DataFrame, schema: str, rows_of) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                        rows = [(doc, *r) for r in rows_of(z)]
                except zipfile.BadZipFile:
                    rows = [(doc, *[None] * (len(schema.split(",")) - 1))] if schema == SAID else []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in schema.split(",")), r, strict=True)) for r in rows], schema=_schema(schema))

    return docs.select("doc_id", "docx").mapInArrow(run, schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in text.split(","))])


def runs(docs: DataFrame) -> DataFrame:
    """The runs of the body's paragraphs of (doc_id, docx); files that are no DOCX and null ones give none."""
    return _mapped(docs, RUNS, _runs)


def said(docs: DataFrame) -> DataFrame:
    """What styles, theme and page settings say, a row for each (doc_id, docx); all null where a file is no DOCX."""
    return _mapped(docs, SAID, lambda z: [_said(z)])
