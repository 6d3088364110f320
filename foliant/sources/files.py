"""Files to documents: text, Markdown, HTML, DOCX and anything else, dispatched by extension."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"md": "text", "markdown": "text", "txt": "text", "html": "html", "htm": "html", "docx": "docx", "pdf": "pdf"}


def format_of(path: Column) -> Column:
    """text, html, docx, pdf or other by the lower-cased extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("other")
    for e, name in FORMATS.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, content, error) of every file below a folder, whatever its size; error is for to_text."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return own.select("path", format_of(F.col("path")).alias("format"), "content", F.lit(None).cast("string").alias("error"))


def to_text(files: DataFrame) -> DataFrame:
    """(path, format, text, error): one text for each file; bytes that are no UTF-8 become U+FFFD.

    HTML becomes Markdown, DOCX the Markdown of its paragraphs and tables; a file that cannot
    be read has an error instead of a text. PDF bytes are not read here: layout operators take
    positioned words.
    """

    def one(kind: str, raw: bytes) -> str:
        if kind == "html":
            return html_markdown(raw.decode(errors="replace"))
        if kind == "docx":
            return docx_markdown(raw)
        if kind == "pdf":
            raise ValueError("no PDF reader; give positioned words")
        return raw.decode(errors="replace")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for kind, raw, error in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                text = None
                if raw is not None:
                    try:
                        text = one(kind, raw)
                    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "format": batch.column(1), "text": pa.array(texts, pa.string()), "error": pa.array(errors, pa.string())})

    return files.select("path", "format", "content", "error").mapInArrow(run, "path string, format string, text string, error string")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_name, text, error) of a folder, ids by the hash of the path; a file that cannot be read has a null text and says why."""
    own = to_text(read_files(spark, path))
    return own.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_name"), "text", "error")


# --- HTML -------------------------------------------------------------------------------------

# fixed values: the elements that are left out, and those that are read through
DROPPED = {"script", "style", "head", "nav", "footer"}
ENTERED = {"div", "section", "article", "main", "body", "header", "html"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}


class _Tree(HTMLParser):
    """A tolerant tree of [tag, attributes, children]; text is a string among the children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["html", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("p", "li") and self.open[-1][0] == tag or tag in ("p", "ul", "ol", "div", "h1", "h2", "h3", "blockquote", "pre") and any(n[0] == "p" for n in self.open[1:]):
            while len(self.open) > 1 and self.open.pop()[0] not in ("p", "li"):
                pass
        node: list = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _strings(node: list | str) -> Iterator[str]:
    """The text parts below a node in page order."""
    stack = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        elif top[0] not in DROPPED:
            stack.extend(reversed(top[2]))


def _inline(node: list) -> str:
    """The trimmed text parts of a node, one space between them."""
    return " ".join(x for part in _strings(node) if (x := part.strip()))


def _first(node: list, tag: str) -> list | None:
    """The first node of a tag below this one, in page order."""
    stack = list(reversed(node[2]))
    while stack:
        top = stack.pop()
        if not isinstance(top, str) and top[0] not in DROPPED:
            if top[0] == tag:
                return top
            stack.extend(reversed(top[2]))
    return None


def _image(node: list) -> str | None:
    src = (node[1].get("src") or "").strip()
    return f"![{(node[1].get('alt') or '').strip()}]({src})" if re.match(r"(?:https?://|data:)", src) else None


def _blocks(node: list) -> Iterator[str | list]:
    """The Markdown blocks of one element, or nodes whose children are read in its place."""
    tag = node[0]
    if tag in ENTERED:
        yield node
    elif re.fullmatch("h[1-6]", tag):
        yield f"{'#' * int(tag[1])} {_inline(node)}"
    elif tag == "p":
        yield _inline(node) or (node if _first(node, "img") else "")
    elif tag == "blockquote":
        yield f"> {text}" if (text := _inline(node)) else ""
    elif tag in ("ul", "ol"):
        yield from (f"- {_inline(c)}" for c in node[2] if not isinstance(c, str) and c[0] == "li")
    elif tag == "hr":
        yield "---"
    elif tag == "img":
        yield _image(node) or ""
    elif tag == "figcaption":
        yield f"*{text}*" if (text := _inline(node)) else ""
    elif tag == "pre":
        yield f"```\n{code}\n```" if (code := "".join(_strings(node)).strip()) else ""
    elif tag == "figure":
        picture, caption = _first(node, "img"), _first(node, "figcaption")
        if picture is None:
            yield node
        elif image := _image(picture):  # a picture that cannot be shown takes its caption with it
            yield f"{image}\n*{text}*" if caption and (text := _inline(caption)) else image


def html_markdown(source: str) -> str:
    """Headings, paragraphs, quotes, list items, rules, code and figures, a blank line between them; other tags go with all they hold."""
    tree = _Tree()
    tree.feed(source)
    tree.close()
    out: list[str] = []
    stack = list(reversed(tree.root[2]))
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node[0] in DROPPED:
            continue
        found = list(_blocks(node))
        if found and isinstance(found[0], list):
            stack.extend(reversed(found[0][2]))
        else:
            out += [x.strip() for x in found if x.strip()]
    return "\n\n".join(out)


def html_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the Markdown of (page_id, html)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array([html_markdown(x or "") for x in batch.column(1).to_pylist()], pa.string())})

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "doc_id long, text string")


# --- DOCX -------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _run_text(run: ElementTree.Element) -> str:
    text = "".join(t.text or "" for t in run.iter(f"{_W}t"))
    props = run.find(f"{_W}rPr")
    marks = "".join(m for m, tag in (("**", "b"), ("*", "i")) if props is not None and props.find(_W + tag) is not None)
    return f"{marks}{text}{marks[::-1]}" if text.strip() and marks else text


def docx_markdown(raw: bytes) -> str:
    """Paragraphs by their style, list paragraphs and tables of the body, in order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[str] = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            rows = [[" ".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in c.iter(f"{_W}p")).strip() for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + "---|" * len(rows[0]), *lines[1:]]))
        elif node.tag == f"{_W}p":
            text = "".join(_run_text(r) for r in node.iter(f"{_W}r")).strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") if style is not None else "") or ""
            if not text:
                continue
            if m := re.match(r"(?i)heading\s*(\d)", name):
                out.append("#" * int(m[1]) + " " + text)
            elif name.lower() == "title":
                out.append(f"# {text}")
            elif "quote" in name.lower():
                out.append(f"> {text}")
            elif node.find(f"{_W}pPr/{_W}numPr") is not None or "list" in name.lower():
                out.append(f"- {text}")
            else:
                out.append(text)
    return re.sub(r"(?m)^(- .*)\n\n(?=- )", r"\1\n", "\n\n".join(out))
