"""The cells of a workbook's first sheet, from its zipped XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    number = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(ch) - 64
    return number - 1


def rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of text cells; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        with book.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{_NS}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
                    if inline is not None:
                        cells[at] = "".join(t.text or "" for t in inline.iter(f"{_NS}t"))
                    elif value is not None:
                        cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
                yield cells
                row.clear()
