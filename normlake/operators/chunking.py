"""Texts to sentences, segments, windows and chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof sr jr st vs etc fig no vol pp inc ltd co cf al eq sec art approx e.g i.e jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
#: A run of end marks and closing marks in front of a space or the end; it begins where no end mark stands before.
_END = re.compile(r"(?<![.!?…])[.!?…][.!?…\"')\]}”’»]*+(?=\s|\Z)")
#: Characters before a dot that are looked at; no abbreviation is longer.
LONGEST_WORD = 16


def _stops(text: str, at: int) -> bool:
    """Whether the mark at a place may end a sentence: no abbreviation's or initial's dot."""
    if text[at] != ".":
        return True
    first = at
    while first and (text[first - 1].isalnum() or text[first - 1] == "."):
        first -= 1
        if at - first > LONGEST_WORD:
            return True
    word = text[first:at].strip(".").lower()
    return not (word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence) with places in UTF-8 bytes. One pass, whatever the length of a line."""
    cuts, found = [0], []
    for m in _END.finditer(text):
        # Of a run like '.)' or '?!' any mark may end the sentence.
        if any(_stops(text, i) for i in range(m.start(), m.end()) if text[i] in ".!?…"):
            cuts.append(m.end())
    at = before = 0
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        part = text[a:b]
        bare = part.strip()
        if bare:
            start = a + len(part) - len(part.lstrip())
            before += len(text[at:start].encode())
            size = len(bare.encode())
            found.append((before, before + size, bare))
            at, before = start + len(bare), before + size
    return found


def segments(text: str) -> list[tuple[int, int, str]]:
    """Lines, each cut into sentences; (start, end, segment) in UTF-8 bytes of the whole text."""
    out, offset = [], 0
    for line in re.findall(r"[^\n]*\n|[^\n]+\Z", text):
        out.extend((offset + a, offset + b, s) for a, b, s in sentences(line))
        offset += len(line.encode())
    return out


def tokens_estimated(text: str) -> int:
    return max(1, -(-len(text) // 4))


def windows(parts: Sequence[tuple[int, int, str]], budget: int, overlap: float) -> list[dict]:
    """Overlapping runs of segments within a token budget; a segment above it stands alone."""
    if not parts or budget == 0:
        return []
    cost = [tokens_estimated(s) for _, _, s in parts]
    shared = int(budget * min(0.95, max(0.0, overlap)))
    out, first = [], 0
    while True:
        last, used = first, cost[first]
        while last + 1 < len(parts) and used + cost[last + 1] <= budget:
            last += 1
            used += cost[last]
        text = "\n".join(f"[{i}] {parts[i][2]}" for i in range(first, last + 1))
        out.append({"idx": len(out), "first": first, "last": last, "start": parts[first][0], "end": parts[last][1], "text": text})
        if last + 1 == len(parts):
            return out
        # Step back over whole segments until the overlap is reached, but always forward of `first`.
        back, step = 0, last + 1
        while step > first + 1 and back < shared:
            step -= 1
            back += cost[step]
        first = step


def read_response(text: str) -> tuple[list[tuple[int, str | None, str | None]], list[int]]:
    """Starts (segment, section, title) and segments to leave out, of a model's JSON answer."""
    found = json.loads(text)
    starts = []
    for s in found.get("starts", []):
        if isinstance(s, dict):
            at = next(s[k] for k in ("i", "index", "start", "segment") if k in s)
            starts.append((int(at), s.get("section"), s.get("title")))
        else:
            starts.append((int(s), None, None))
    return starts, [int(i) for i in found.get("leave_out", [])]


def assemble(text: str, responses: Sequence[tuple[Sequence[tuple[int, str | None, str | None]], Sequence[int]]]) -> list[dict]:
    """Chunks from segment starts; headings are inherited by later chunks, left-out segments drop."""
    parts = segments(text)
    if not parts:
        return []
    n = len(parts)
    starts: dict[int, tuple[str | None, str | None]] = {}
    out_of: set[int] = set()
    for given, left in responses:
        for i, section, title in given:
            if i < n:
                starts.setdefault(i, (section, title))
        out_of.update(left)
    starts.setdefault(0, (None, None))
    order = sorted(starts)
    chunks, section, title = [], None, None
    for a, b in zip(order, [*order[1:], n], strict=True):
        kept = [parts[i][2] for i in range(a, b) if i not in out_of]
        if kept:
            own = starts[a]
            section = own[0] if own[0] and own[0].strip() else section
            title = own[1] if own[1] and own[1].strip() else title
            chunks.append({"chunk_index": len(chunks), "char_start": parts[a][0], "char_end": parts[b - 1][1], "text": "\n".join(kept), "section": section, "title": title})
    return chunks


def segment_table(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, start, end, segment) of every document; null and blank texts have none."""

    @F.pandas_udf("array<struct<start long, end long, segment string>>")
    def cut_all(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield texts.map(lambda t: [{"start": a, "end": b, "segment": s} for a, b, s in segments(t)] if t else [])

    return documents.select(key, F.posexplode(cut_all(text)).alias("idx", "s")).select(key, "idx", "s.*")


def window_table(documents: DataFrame, budget: int, overlap: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx, first, last, start, end, text) of every window of every document."""

    @F.pandas_udf("array<struct<idx long, first long, last long, start long, end long, text string>>")
    def all_windows(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield texts.map(lambda t: windows(segments(t), budget, overlap) if t else [])

    return documents.select(key, F.explode(all_windows(text)).alias("w")).select(key, "w.*")


# Chunks of laid-out lines.

#: Fixed patterns: (priority, role, pattern, flags) of the default profile.
LINE_PATTERNS = (
    (200, "ignore", r"(?:Seite|Page|Bundesgesetzblatt|Amtsblatt|BAnz)", "i"),
    (110, "heading_l1", r"^(\d+(\.\d+)*\.?|\([a-zA-Z0-9]\))\s+[A-Za-zÄÖÜäöüß].{0,79}$", "i"),
    (100, "heading_l1", r"^((?:Article|Art\.|§|AT|Kapitel|Abschnitt|TITEL|TITLE|CHAPTER)\s*[\d.a-zA-Z]+)\s*(.*)", "i"),
    (50, "definition", r"\b(?:means|shall mean|bezeichnet|gilt als|im Sinne)", "i"),
)
#: Words of a section under which numbered ones are put.
MAJOR = ("Art", "§", "Kapitel", "Abschnitt", "TITEL", "TITLE", "CHAPTER")


@dataclass(frozen=True)
class LineProfile:
    """Patterns of line roles, and the least and most bytes of a chunk. Patterns that do not compile are left out."""

    patterns: tuple[tuple[int, str, str, str], ...] = LINE_PATTERNS
    least: int = 200
    most: int = 1500

    def compiled(self) -> list[tuple[str, re.Pattern]]:
        out = []
        for _, role, pattern, flags in sorted(self.patterns, key=lambda p: -p[0]):
            try:
                out.append((role, re.compile(pattern, re.I * ("i" in flags) | re.M * ("m" in flags))))
            except re.error:
                continue
        return out

    @classmethod
    def from_triggers(cls, headings: str, definitions: str, ignores: str, most: int) -> LineProfile:
        """The profile of comma-separated trigger words."""
        words = [[w.strip() for w in t.split(",") if w.strip()] for t in (headings, definitions, ignores)]
        shapes = ((100, "heading_l1", r"^((?:{})\s*[\d.a-zA-Z]+)\s*(.*)"), (50, "definition", r"\b(?:{})"), (200, "ignore", "(?:{})"))
        return cls(tuple((n, role, shape.format("|".join(w)), "i") for (n, role, shape), w in zip(shapes, words, strict=True) if w), 200, most)


@dataclass
class Line:
    """A line with its role: section and title are what a heading names."""

    text: str
    page: int
    role: str | None
    section: str | None
    title: str | None
    fresh: bool = True


def classified(lines: Sequence[tuple[int, int, str, float, bool]], profile: LineProfile) -> list[Line]:
    """Roles of lines (page, y in tenths, text, font size, bold); contents lines and ignored ones are gone.

    A short line without a role that opens a paragraph in large or bold type is
    a heading, too. Large is a tenth above the mean size over all characters.
    """
    compiled = profile.compiled()
    chars = sum(len(t) for _, _, t, _, _ in lines)
    mean = sum(size * len(t) for _, _, t, size, _ in lines) / chars if chars else 0.0
    out: list[Line] = []
    above: tuple[int, int] | None = None
    for page, y, raw, size, bold in lines:
        text = raw.strip()
        if not text or ("..." in text and text[-1].isnumeric()):
            continue
        role, m = next(((r, f) for r, p in compiled if (f := p.search(text))), (None, None))
        if role == "ignore":
            continue
        fresh = above is None or above[0] != page or abs(above[1] - y) / 10 > 1.5 * size
        above = (page, y)
        section = title = None
        if role and role.startswith("heading"):
            groups = [g.strip() if g is not None else None for g in m.groups()]
            section, title = (groups + [None, None])[:2] if groups else (None, text)
        elif role is None and fresh and len(text.encode()) < 80 and text[-1] not in ".,:;" and (size > 1.1 * mean or bold):
            role, title = "heading_l1", text
        out.append(Line(text, page, role, section, title, fresh))
    return out


def _overlong(text: str, most: int) -> int | None:
    """Byte at which an overlong text is cut: after the sentence that passes `most`, never the first alone."""
    ends = [b for _, b, _ in sentences(text)]
    if len(ends) < 2:
        return None
    at = next((i for i, b in enumerate(ends) if b > most), len(ends) - 1)
    return ends[max(1, at)]


def structural_chunks(lines: Sequence[tuple[int, int, str, float, bool]], profile: LineProfile | None = None) -> list[dict]:
    """Chunks of laid-out lines: text, section, title, page, signature.

    A heading begins a chunk; a definition or a numbered paragraph does once the
    chunk has `least` bytes, any paragraph once it has `most`. Below a major
    section a numbered heading is named after both. A chunk shorter than `least`
    joins the one before it, across sections; one above twice `most` is cut at a
    sentence.
    """
    profile = profile or LineProfile()
    out: list[dict] = []
    body = ""
    page = section = title = major = None

    def flush(text: str) -> None:
        bare = text.strip()
        if bare and out and len(bare.encode()) < profile.least:
            out[-1]["text"] += "\n" + bare
        elif bare:
            out.append({"text": text, "section": section or "", "title": title or "", "page": (page or 0) + 1, "signature": bare[:80]})

    for line in classified(lines, profile):
        heading = bool(line.role) and line.role.startswith("heading")
        size = len(body.encode())
        opens = line.role == "definition" or (line.fresh and line.text[0] in "0123456789")
        if bool(body.strip()) if heading else size >= profile.least if opens else line.fresh and size >= profile.most:
            flush(body)
            body = ""
        if heading:
            if line.section is not None:
                if any(w in line.section for w in MAJOR):
                    major = section = line.section
                else:
                    section = f"{major} {line.section}" if major else line.section
            if line.title is not None:
                title = line.title
            elif line.section is None:
                title = line.text
        if not body:
            page = line.page
        body += line.text + "\n"
        if len(body.encode()) > 2 * profile.most and (cut_at := _overlong(body, profile.most)):
            raw = body.encode()
            flush(raw[:cut_at].decode())
            body, page = raw[cut_at:].decode().lstrip(), line.page
    flush(body)
    return out


def mean_font_size(lines: DataFrame) -> DataFrame:
    """(doc_id, mean): the mean font size of lines(doc_id, text, size) over their characters; null without any."""
    chars = F.length(F.coalesce("text", F.lit("")))
    total = F.sum(chars)
    return lines.groupBy("doc_id").agg(F.when(total > 0, F.sum(F.col("size") * chars) / total).alias("mean"))


def fresh_lines(lines: DataFrame) -> DataFrame:
    """lines(doc_id, page, line_no, y, size, ...) with `fresh`: the line opens a paragraph.

    It does as the first of its document or page, or more than one and a half
    font sizes away from the line before; y is in tenths. Empty lines are out.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    used = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    page, y = F.lag("page").over(w), F.lag("y").over(w)
    return used.withColumn("fresh", page.isNull() | (page != F.col("page")) | (F.abs(y - F.col("y")) / 10 > 1.5 * F.col("size")))


def continued_sections(chunks: DataFrame, most: int) -> DataFrame:
    """(chunk_id, continuation, continues_at): for every chunk with a section, the chunks that carry the section on.

    chunks(id, document_id, chunk_index, section, is_omitted). Those with the next
    places in the document and the same section follow, up to an omitted one, a
    gap or another section; at most `most` of them, and continues_at is the one
    after those, if the section goes on. The chunk itself may be omitted. Of
    chunks with one place the smallest id stands there. A null section, and an
    empty one, is none.
    """
    named = chunks.select("id", "document_id", "chunk_index", F.when(F.trim("section") != "", F.col("section")).alias("section"), F.coalesce("is_omitted", F.lit(False)).alias("out"))
    row = F.struct("id", "section", "out")
    placed = named.groupBy("document_id", "chunk_index").agg(F.min_by(row, "id").alias("r")).select("document_id", "chunk_index", "r.*")
    ahead = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(1, most + 1)
    following = placed.select("document_id", "chunk_index", F.collect_list(F.struct("chunk_index", "id", "section", "out")).over(ahead).alias("next"))
    starts = named.where("section is not null").join(following, ["document_id", "chunk_index"])
    # The row at place i carries on if its index is i + 1 further and it is of the section; the first that does not ends it.
    carries = F.transform("next", lambda x, i: (x["chunk_index"] == F.col("chunk_index") + i + 1) & ~x["out"] & x["section"].eqNullSafe(F.col("section")))
    first_out = F.array_position(carries, False)
    held = F.when(first_out > 0, first_out - 1).otherwise(F.size(carries)).cast("int")
    run = F.slice("next", F.lit(1), held)
    return starts.select(
        F.col("id").alias("chunk_id"),
        F.transform(F.slice(run, 1, most), lambda x: x["id"]).alias("continuation"),
        F.when(held > most, F.try_element_at(run, F.lit(most + 1))["id"]).alias("continues_at"),
    )


def structural_table(lines: DataFrame, profile: LineProfile | None = None) -> DataFrame:
    """(doc_id, chunk_index, text, section, title, page, signature) of lines(doc_id, page, y, line_no, text, size, bold), per document."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page", "line_no"])
        found = structural_chunks(list(rows[["page", "y", "text", "size", "bold"]].itertuples(index=False, name=None)), profile)
        table = pd.DataFrame(found, columns=["text", "section", "title", "page", "signature"])
        table.insert(0, "chunk_index", range(len(table)))
        table.insert(0, "doc_id", rows["doc_id"].iloc[0])
        return table

    schema = "doc_id long, chunk_index long, text string, section string, title string, page long, signature string"
    return lines.groupBy("doc_id").applyInPandas(one, schema)
