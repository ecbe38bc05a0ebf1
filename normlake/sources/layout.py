"""Laid-out lines of pages, from hOCR files.

hOCR is an open format in which text extraction tools write the lines of a page
as HTML with their boxes and font sizes. The lines are what structural chunking
takes (page, place, text, size, bold); a PDF has to be turned into them first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Classes of lines, and the elements that make text bold.
LINE_CLASSES = frozenset("ocr_line ocr_header ocr_caption ocr_textfloat ocrx_line".split())
BOLD = frozenset(("strong", "b"))
_BOX = re.compile(r"\bbbox\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)")
_SIZE = re.compile(r"\bx_(?:fsize|size)\s+([\d.]+)")
_PAGE = re.compile(r"\bppageno\s+(\d+)")
#: Elements without an end.
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

SCHEMA = "path string, page long, line_no long, y long, text string, size double, bold boolean"


class _Lines(HTMLParser):
    """Collects (page, y, text, size, bold) of every line; y in tenths, size from the box where it is not given."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, int, str, float, bool]] = []
        self.page = -1
        self.depth = self.bold_depth = 0
        self.line: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _EMPTY:
            if self.line is not None and tag == "br":
                self.line["text"].append(" ")
            return
        self.depth += 1
        given = {k: v or "" for k, v in attrs}
        classes, title = set(given.get("class", "").split()), given.get("title", "")
        if "ocr_page" in classes:
            m = _PAGE.search(title)
            self.page = int(m[1]) if m else self.page + 1
        if tag in BOLD:
            self.bold_depth += 1
        if classes & LINE_CLASSES and self.line is None:
            box, size = _BOX.search(title), _SIZE.search(title)
            x0, y0, x1, y1 = map(int, box.groups()) if box else (0, 0, 0, 0)
            self.line = {"depth": self.depth, "y": 10 * y0, "size": float(size[1]) if size else float(y1 - y0), "text": [], "bold": 0, "all": 0}

    def handle_data(self, data: str) -> None:
        if self.line is not None:
            n = len("".join(data.split()))
            self.line["text"].append(data)
            self.line["all"] += n
            self.line["bold"] += n if self.bold_depth else 0

    def handle_endtag(self, tag: str) -> None:
        if tag in _EMPTY:
            return
        if tag in BOLD and self.bold_depth:
            self.bold_depth -= 1
        if self.line is not None and self.depth <= self.line["depth"]:
            text = " ".join("".join(self.line["text"]).split())
            if text:
                self.found.append((max(0, self.page), self.line["y"], text, self.line["size"], 2 * self.line["bold"] > self.line["all"]))
            self.line = None
        self.depth -= 1


def lines_of(hocr: str) -> list[tuple[int, int, str, float, bool]]:
    """(page, y, text, size, bold) of the lines of one hOCR text, in order; empty lines are out."""
    parser = _Lines()
    parser.feed(hocr)
    parser.close()
    return parser.found


def read_hocr(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, line_no, y, text, size, bold) of all hOCR files under a path, a file at a time in one task.

    Undecodable bytes are replaced. A file without lines gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, p, i, y, t, s, b) for i, (p, y, t, s, b) in enumerate(lines_of(content.as_py().decode("utf-8", "replace")))]
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)
