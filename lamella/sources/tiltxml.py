"""Tilt-series XML: structure as rows, edits of per-tilt values by spans of the text, byte-exact output.

Nothing is rebuilt from a tree: an edit replaces the spans it is about, so all other bytes stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.session import ship

from .star import file_path

# Byte-order marks and the declaration of the format.
UTF8, UTF16, UTF16_BE = b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff"
DECLARATION = '<?xml version="1.0" encoding="{}"?>'

_MARK = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<(?P<end>/?)(?P<tag>[\w:.-]+)(?P<attrs>[^<>]*?)(?P<empty>/?)>", re.S)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


def decode(raw: bytes) -> tuple[str, str]:
    """(text, "utf-8" or "utf-16"): byte-order marks tell; without one the text is UTF-8."""
    for mark, codec, name in ((UTF16, "utf-16-le", "utf-16"), (UTF16_BE, "utf-16-be", "utf-16"), (UTF8, "utf-8", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(codec), name
    return raw.decode("utf-8"), "utf-8"


def encode(text: str, encoding: str) -> bytes:
    """The file's bytes: mark, declaration with double quotes, a blank before the end of empty tags, line ends as they are."""
    body = re.sub(r"^\s*<\?xml.*?\?>\s*", "", text, flags=re.S)
    body = re.sub(r'(?<=")/>', " />", body).rstrip("\r\n")
    head = DECLARATION.format(encoding) + ("\r\n" if "\r" in body else "\n")
    return UTF16 + (head + body).encode("utf-16-le") if encoding == "utf-16" else UTF8 + (head + body).encode()


@dataclass
class Element:
    """An element by its spans: open tag [start, inside), content [inside, close), close tag up to ``end``."""

    tag: str
    start: int
    inside: int
    close: int
    end: int
    attributes: dict[str, str]
    children: list[Element] = field(default_factory=list)


def elements(text: str) -> Element:
    """The root element; ValueError if tags do not match."""
    stack: list[Element] = []
    for m in _MARK.finditer(text):
        if m["tag"] is None:
            continue
        if m["end"]:
            if not stack or stack[-1].tag != m["tag"]:
                raise ValueError(f"unexpected </{m['tag']}>")
            e = stack.pop()
            e.close, e.end = m.start(), m.end()
            if not stack:
                return e
            continue
        e = Element(m["tag"], m.start(), m.end(), m.end(), m.end(), {k: unescape(v[1:-1], {"&quot;": '"'}) for k, v in _ATTRIBUTE.findall(m["attrs"])})
        if stack:
            stack[-1].children.append(e)
        if not m["empty"]:
            stack.append(e)
        elif not stack:
            return e
    raise ValueError("no root element")


def entries(text: str, e: Element) -> list[str] | None:
    """A list element's entries (one empty entry at the end is dropped); None for groups, indexed and empty elements."""
    if e.children or "ID" in e.attributes or e.inside == e.close:
        return None
    parts = text[e.inside : e.close].split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def _indexed(root: Element, n: int) -> list[list[Element]]:
    """Groups of siblings whose IDs are 0..n-1, by ID."""
    groups: dict[str, list[Element]] = {}
    for e in root.children:
        if "ID" in e.attributes:
            groups.setdefault(e.tag, []).append(e)
    ordered = [sorted(g, key=lambda e: int(e.attributes["ID"])) for g in groups.values()]
    return [g for g in ordered if [int(e.attributes["ID"]) for e in g] == list(range(n))]


def _with(markup: str, name: str, value) -> str:
    """An open tag with one attribute's value replaced."""
    return re.sub(rf"(\s{name}\s*=\s*)(\"[^\"]*\"|'[^']*')", lambda m: f"{m[1]}{m[2][0]}{value}{m[2][0]}", markup, count=1)


def _apply(text: str, edits: list[tuple[int, int, str]]) -> str:
    for start, end, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[end:]
    return text


def delete_tilts(text: str, gone: set[int]) -> str:
    """The text without these tilts: list entries, indexed elements and grid slices go, numbers close up, Depth follows."""
    root = elements(text)
    use = next(e for e in root.children if e.tag == "UseTilt")
    n = len(entries(text, use) or [])
    keep = [i for i in range(n) if i not in gone]
    new = {old: i for i, old in enumerate(keep)}
    edits: list[tuple[int, int, str]] = []
    for e in root.children:
        values = entries(text, e)
        if values is not None and len(values) == n:
            edits.append((e.inside, e.close, "\n".join(values[i] for i in keep)))
        nodes = [c for c in e.children if c.tag == "Node"]
        if nodes and int(e.attributes.get("Depth", -1)) == n:
            tails = [text[a.end : b] for a, b in zip(nodes, [*(c.start for c in nodes[1:]), e.close], strict=True)]
            left = [c for c in nodes if int(c.attributes["Z"]) in new]
            marks = [_with(text[c.start : c.end], "Z", new[int(c.attributes["Z"])]) for c in left]
            between = tails[0] if len(nodes) > 1 else tails[-1]
            edits.append((e.start, e.inside, _with(text[e.start : e.inside], "Depth", len(keep))))
            edits.append((e.inside, e.close, text[e.inside : nodes[0].start] + between.join(marks) + (tails[-1] if marks else "")))
    for group in _indexed(root, n):
        for i, e in enumerate(group):
            if i in new:
                edits.append((e.start, e.inside, _with(text[e.start : e.inside], "ID", new[i])))
            else:  # with the blanks that follow
                after = text.find("<", e.end)
                edits.append((e.start, after, ""))
    return _apply(text, edits)


def set_entries(text: str, tag: str, values: list[str | None]) -> str:
    """The text with a list's entries replaced; None keeps one."""
    e = next(e for e in elements(text).children if e.tag == tag)
    old = entries(text, e) or []
    if len(old) != len(values):
        raise ValueError(f"<{tag}> has {len(old)} entries, expected {len(values)}")
    return _apply(text, [(e.inside, e.close, "\n".join(o if v is None else v for o, v in zip(old, values, strict=True)))])


# ---------------------------------------------------------------- DataFrames
def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(path, series, xml, encoding): tilt-series XML of a glob pattern."""
    ship(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [decode(bytes(x)) for x in b["content"]]
            yield pd.DataFrame({"path": b["path"], "xml": [t for t, _ in got], "encoding": [e for _, e in got]})

    raw = spark.read.format("binaryFile").load(path).select(file_path(F.col("path")).alias("path"), "content").mapInPandas(read, "path string, xml string, encoding string")
    return raw.withColumn("series", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.xml(\.bak)?$", ""))


def element_rows(series: DataFrame) -> DataFrame:
    """(series, k, tag, id, width, height, depth, entries, zs, error): the root's children in order; a file that cannot be read is one row with an error."""
    ship(series.sparkSession)
    schema = "series string, k int, tag string, id int, width int, height int, depth int, entries array<string>, zs array<int>, error string"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, text in zip(b["series"], b["xml"], strict=True):
                try:
                    for k, e in enumerate(elements(text).children):
                        number = {a: int(e.attributes[a]) if a in e.attributes else None for a in ("ID", "Width", "Height", "Depth")}
                        zs = [int(c.attributes["Z"]) for c in e.children if c.tag == "Node"] or None
                        values = entries(text, e)
                        out.append((name, k, e.tag, *number.values(), None if values is None else [unescape(v) for v in values], zs, None))
                except (ValueError, KeyError) as x:
                    out.append((name, -1, None, None, None, None, None, None, None, str(x)))
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])
            for c in ("id", "width", "height", "depth"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return series.select("series", "xml").mapInPandas(rows, schema)


def edited(series: DataFrame, gone: str = "gone", lists: tuple[str, ...] = ("Dose", "Angles", "UseTilt")) -> DataFrame:
    """``series`` with ``content``, the new file's bytes: columns named as ``lists`` hold new entries (arrays, null entries or a
    null array keep), ``gone`` the tilts to delete; entries are set first."""
    ship(series.sparkSession)
    keys = ["series", "xml", "encoding", gone, *lists]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                text = r.xml
                for tag in lists:
                    values = getattr(r, tag)
                    if values is not None:
                        text = set_entries(text, tag, list(values))
                drop = getattr(r, gone)
                if drop is not None and len(drop):
                    text = delete_tilts(text, {int(i) for i in drop})
                out.append(encode(text, r.encoding))
            yield pd.DataFrame({"series": b["series"], "content": out})

    new = series.select(*keys).mapInPandas(work, "series string, content binary")
    return series.join(new, "series")
