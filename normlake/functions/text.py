"""Text expressions shared by keyword search and evaluation."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _accented() -> dict[str, str]:
    """Every small letter that is another one with marks, by the Unicode decomposition, and ø, which has none."""
    found = {"ø": "o"}
    for c in map(chr, range(0xC0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and c == c.lower() and base.isalpha() and all(unicodedata.category(m) == "Mn" for m in marks):
            found[c] = base
    return found


#: Accented letters and what they are searched as.
ACCENTED, PLAIN = map("".join, zip(*sorted(_accented().items()), strict=True))


def search_tokens(text: Column) -> Column:
    """Lower-cased, accent-free runs of letters and digits."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def plain_tokens(text: str) -> list[str]:
    """search_tokens of one string, on the driver."""
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(ACCENTED, PLAIN)))


def query_terms(query: str) -> list[str]:
    """The terms of a keyword query: its words with a letter or digit. Double quotes in them are dropped."""
    return [w for w in (t.replace('"', "") for t in query.split()) if any(c.isalnum() for c in w)]


def match_expression(query: str) -> str:
    """The query as quoted terms joined by OR; empty if there is none."""
    return " OR ".join(f'"{t}"' for t in query_terms(query))


def collapsed(text: Column) -> Column:
    """Lower case with single spaces, for anchors."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")
